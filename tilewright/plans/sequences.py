"""Queries of sequences, regions and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import regions as rg
from tilewright.operators import sequences as sq
from tilewright.operators import texts as tx
from tilewright.plans.registry import query

# ---- sequences -----------------------------------------------------------


@query(
    "label_rows",
    """with g as (select *, ord%45=1 and ord>1 as gt from v_ranges), s as (select seq_id, min(ord) as stop from g where gt group by seq_id),
    u as (select g.* from g left join s on g.seq_id=s.seq_id where stop is null or ord<=stop)
    select r.seq_id, r.t, coalesce(max_by(u.label, u.ord),'background') as range_label from v_rows r left join u on u.seq_id=r.seq_id and r.t between u.lo and u.hi group by r.seq_id, r.t""",
)
def label_rows(v):
    ranges = v.ranges.withColumn("ground_truth", (F.col("ord") % 45 == 1) & (F.col("ord") > 1))
    return sq.label_rows(v.rows.select("seq_id", "t"), ranges)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "label_frames",
    """with m as (select seq_id, max(hi) as n from v_ranges group by seq_id), l as (select distinct event_type as label from events),
    f as (select seq_id, unnest(range(1,n+1)) as frame from m)
    select f.seq_id as video_id, f.frame, l.label, cast(exists(select 1 from v_ranges r where r.seq_id=f.seq_id and r.label=l.label and f.frame between r.lo and r.hi) as int) as value from f cross join l""",
)
def label_frames(v):
    return sq.label_frames(v.ranges.withColumnRenamed("seq_id", "video_id"), EVENT_TYPES)


RUN_SQL = """(select *, sum(chg) over(partition by seq_id order by t) as run from (select *, case when {s} is distinct from lag({s}) over(partition by seq_id order by t) then 1 else 0 end as chg from {src} q) p)"""


@query(
    "segments",
    f"select seq_id, label, min(t) as start, max(t) as \"end\", round(avg(score),9) as score, min(t)=max(t) as instant from {RUN_SQL.format(s='label', src='v_rows')} r where label<>'view' group by seq_id, run, label",
)
def segments(v):
    return sq.segments(v.rows, "view").withColumn("score", F.round("score", 9))


@query(
    "sequence_score",
    f"select seq_id, round(avg(score),9) as score from (select seq_id, avg(score) as score from {RUN_SQL.format(s='label', src='v_rows')} r where label<>'view' group by seq_id, run) s group by seq_id",
)
def sequence_score(v):
    return sq.sequence_score(sq.segments(v.rows, "view")).withColumn("score", F.round("score", 9))


@query(
    "threshold_segments",
    """with f as (select *, frame-row_number() over(partition by video_id,label_idx order by frame) as g from v_probs where prob>=0.5e0),
    s as (select video_id, label_idx, label, min(frame) as start, max(frame) as fin, avg(prob) as score from f group by video_id, label_idx, label, g)
    select video_id, label, start, fin as "end", round(score,9) as score, concat(row_number() over(partition by video_id order by start,label_idx)-1,'_',start,'_',fin) as id from s""",
)
def threshold_segments(v):
    return sq.threshold_segments(v.probs, 0.5).withColumn("score", F.round("score", 9))


BIO = "(select seq_id, t, score, case label when 'view' then 'O' when 'click' then 'B-A' when 'error' then 'I-A' when 'purchase' then 'B-B' else 'I-B' end as label from v_rows)"


def bio(v):
    t = F.col("label")
    tag = F.when(t == "view", "O").when(t == "click", "B-A").when(t == "error", "I-A").when(t == "purchase", "B-B").otherwise("I-B")
    return v.rows.select("seq_id", "t", "score", tag.alias("label"))


STRIPPED = f"(select seq_id, t, score, label, regexp_replace(label,'^[BI]-','') as entity from {BIO} b)"


@query(
    "entity_spans",
    f"select seq_id, entity, min(t) as start, max(t) as \"end\", round(avg(score),9) as score from {RUN_SQL.format(s='entity', src=STRIPPED)} r where entity<>'O' group by seq_id, run, entity",
)
def entity_spans(v):
    return sq.entity_spans(bio(v)).withColumn("score", F.round("score", 9))


@query(
    "entity_spans_split",
    f"""with b as (select *, case when entity='O' then '' else concat(entity,'/',sum(case when label like 'B-%' then 1 else 0 end) over(partition by seq_id order by t)) end as st from {STRIPPED} s)
    select seq_id, entity, min(t) as start, max(t) as "end", round(avg(score),9) as score from {RUN_SQL.format(s='st', src='b')} r where entity<>'O' group by seq_id, run, entity""",
)
def entity_spans_split(v):
    return sq.entity_spans(bio(v), split_on_b=True).withColumn("score", F.round("score", 9))


@query(
    "track_lifespans",
    "select video_id, track_id, frame, coalesce(lead(frame) over(partition by video_id, track_id order by frame)-frame=1,false) as enabled from v_tracks",
)
def track_lifespans(v):
    return sq.track_lifespans(v.tracks.select("video_id", "track_id", "frame"))


@query(
    "track_regions",
    """with n as (select *, row_number() over(partition by video_id,track_id order by frame) rn from v_tracks),
    s as (select video_id, track_id, count(*) as boxes, min(frame) as first_frame, max(frame) as last_frame, round(max(score),9) as score, max_by(concat('c',x%5),frame) as label from v_tracks group by all)
    select n.video_id, n.track_id, cast(floor((rn-1)/10000) as bigint) as part, string_agg(concat(frame,':',x), ' ' order by frame) as sequence, any_value(boxes) as boxes, any_value(first_frame) as first_frame,
    any_value(last_frame) as last_frame, any_value(s.score) as score, any_value(label) as label from n join s on n.video_id=s.video_id and n.track_id=s.track_id group by n.video_id, n.track_id, part""",
)
def track_regions(v):
    tracks = v.tracks.withColumn("cls", F.concat(F.lit("c"), F.col("x") % 5))
    out = sq.track_regions(tracks, F.concat_ws(":", "frame", "x"), "cls")
    return out.withColumn("sequence", F.array_join("sequence", " ")).withColumn("score", F.round("score", 9))


WINDOWS = """n as (select seq_id, count(*) as n from v_rows group by seq_id),
    st as (select seq_id, unnest(range(0, n-10+1, 5)) as start from n where n>=10 union select seq_id, n-10 from n where n>=10)"""


@query("sliding_windows", f"with {WINDOWS} select r.seq_id, start, r.t-1-start as pos, r.t, r.label from st join v_rows r on r.seq_id=st.seq_id and r.t-1>=start and r.t-1<start+10")
def sliding_windows(v):
    return sq.sliding_windows(v.rows.select("seq_id", "t", "label"), 10, 0.5)


@query(
    "pad_sequences",
    """with n as (select seq_id, count(*) as n from v_rows group by seq_id), g as (select seq_id, n, unnest(range(0,80)) as pos, (80-n)//2+(80-n)%2 as front from n where n<80),
    m as (select seq_id, n, pos, pos-front>=0 and pos-front<n as real, case when pos<front then n-1-pos%n when pos<front+n then pos-front else n-1-(pos-front-n)%n end+1 as t from g)
    select m.seq_id, m.pos, m.real, r.score, case when m.real then r.event_id else -1 end as event_id from m join v_rows r on r.seq_id=m.seq_id and r.t=m.t""",
)
def pad_sequences(v):
    return sq.pad_sequences(v.rows, 80, "reflect", ["score"], "event_id")


@query(
    "chunk_pad_zero",
    """with n as (select seq_id, count(*) as n from v_rows group by seq_id), w as (select seq_id, n, unnest(range(0,n,6)) as start from n), g as (select seq_id, start, unnest(range(0,least(12,n))) as pos from w)
    select g.seq_id, g.start, g.pos, coalesce(r.score,0) as score from g left join v_rows r on r.seq_id=g.seq_id and r.t-1=g.start+g.pos""",
)
def chunk_pad_zero(v):
    return sq.chunk_pad_zero(v.rows, 12, 2)


@query(
    "overlap_average",
    f"""with {WINDOWS}, k as (select unnest(range(0,3)) as label_idx),
    p as (select st.seq_id, start+g.pos+1 as t, label_idx, ((start+g.pos+1)*31+start*17+label_idx*7)%101 as v from st, k, (select unnest(range(0,10)) as pos) g
      union all select seq_id, g.pos-(10-n)//2+1, label_idx, (g.pos*31+label_idx*7)%101 from n, k, (select unnest(range(0,10)) as pos) g where n<10 and g.pos-(10-n)//2 between 0 and n-1)
    select seq_id, t, label_idx, round(avg(v/101e0),9) as prob from p group by all""",
)
def overlap_average(v):
    rows = v.rows.select("seq_id", "t", "score")
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("label_idx")
    long = sq.sliding_windows(rows, 10, 0.5).select("seq_id", "start", "pos", "t", k)
    long = long.withColumn("prob", ((F.col("t") * 31 + F.col("start") * 17 + F.col("label_idx") * 7) % 101) / 101)
    short = sq.pad_sequences(rows, 10, "zero").select("seq_id", F.lit(0).cast("bigint").alias("start"), "pos", k)
    short = short.withColumn("prob", ((F.col("pos") * 31 + F.col("label_idx") * 7) % 101) / 101)
    preds = long.drop("t").unionByName(short)
    return sq.overlap_average(preds, sq.sequence_lengths(rows), 10).withColumn("prob", F.round("prob", 9))


@query("argmax_label", "select video_id, frame, label_idx, label, round(prob,9) as score from (select *, row_number() over(partition by video_id, frame order by prob desc, label_idx) rn from v_probs) q where rn=1")
def argmax_label(v):
    return sq.argmax_label(v.probs).withColumn("score", F.round("score", 9))


@query("class_weights", "select label, n, round(n*1e0/sum(n) over()*100,9) as percent, round(sum(n) over()*1e0/(count(*) over()*n),9) as weight from (select label, count(*) as n from v_rows where label<>'-1' group by label) q")
def class_weights(v):
    return sq.class_weights(v.rows)


CLASS_SQL = """(select *, case when p+r>0 then 2*p*r/(p+r) else 0e0 end as f1 from (select cls, actual, case when predicted>0 then tp*1e0/predicted else 0e0 end as p, case when actual>0 then tp*1e0/actual else 0e0 end as r
    from (select cls, count(*) filter (truth=cls and pred=cls) as tp, count(*) filter (pred=cls) as predicted, count(*) filter (truth=cls) as actual from v_pred, (select unnest(range(0,5)) as cls) c group by cls) a) b)"""


@query("multiclass_metrics", f"select round(avg(p),9) as precision, round(avg(r),9) as recall, round(avg(f1),9) as f1, round(avg(r) filter (actual>0),9) as balanced_accuracy, round(min(f1) filter (f1>0),9) as min_f1 from {CLASS_SQL} m")
def multiclass_metrics(v):
    return sq.multiclass_metrics(v.pred)


@query("class_metrics", f"select cls, round(p,9) as precision, round(r,9) as recall, round(f1,9) as f1 from {CLASS_SQL} m")
def class_metrics(v):
    return sq.class_metrics(v.pred).select("cls", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "multilabel_metrics",
    """with c as (select label, count(*) filter (prob>0.5e0 and tr) as tp, count(*) filter (prob>0.5e0 and not tr) as fp, count(*) filter (prob<=0.5e0 and tr) as fn, count(*) filter (prob<=0.5e0 and not tr) as tn
      from (select *, (frame+label_idx)%3=0 as tr from v_probs) q group by label)
    select round(avg(case when tp+fp=0 then 1e0 else tp*1e0/(tp+fp) end),9) as precision, round(avg(case when tp+fn=0 then 1e0 else tp*1e0/(tp+fn) end),9) as recall,
    round(avg(case when 2*tp+fp+fn=0 then 1e0 else 2e0*tp/(2*tp+fp+fn) end),9) as f1, round(avg((tp+tn)*1e0/(tp+fp+fn+tn)),9) as accuracy from c""",
)
def multilabel_metrics(v):
    truth = F.when((F.col("frame") + F.col("label_idx")) % 3 == 0, 1).otherwise(0)
    return sq.multilabel_metrics(v.probs.withColumn("truth", truth), 0.5)


# ---- regions -------------------------------------------------------------

UI = """(select label, row_number() over(order by label) as ord, case when p_size%3=2 then concat('m-',label,', nothing') else '' end as pv from (select distinct concat(p_type,'-',p_size) as label, p_size from part) p)"""
MODEL = "(select distinct case p_size%3 when 0 then lower(concat(p_type,'-',p_size)) when 1 then concat(p_type,'-',p_size) else concat('m-',p_type,'-',p_size) end as name from part where p_size%4<>0)"


@query(
    "label_map",
    f"""with u as (select * from {UI} a), m as (select * from {MODEL} a),
    t1 as (select m.name, u.label, u.ord from u join m on u.pv<>'' and m.name=concat('m-',u.label)),
    t2 as (select m.name, u.label, u.ord from u join m on m.name=u.label where u.label not in (select label from t1)),
    t3 as (select distinct lower(u.label) as name, u.label, u.ord from u join m on lower(m.name)=lower(u.label) where u.label not in (select label from t1) and u.label not in (select label from t2)),
    p as (select * from t1 union all select * from t2 union all select * from t3)
    select name as model_label, max_by(label, ord) as ui_label from p group by name""",
)
def label_map(v):
    part = v.table("part").select(F.concat_ws("-", "p_type", "p_size").alias("label"), "p_size").distinct()
    listed = F.when(F.col("p_size") % 3 == 2, F.concat(F.lit("m-"), "label", F.lit(", nothing"))).otherwise("")
    ui = tx.number_rows(part, [], ["label"], "ord").withColumn("predicted_values", listed)
    k = F.col("p_size") % 3
    name = F.when(k == 0, F.lower("label")).when(k == 1, F.col("label")).otherwise(F.concat(F.lit("m-"), "label"))
    return rg.label_map(ui, part.filter("p_size % 4 <> 0").select(name.alias("name")))


def class_map(v):
    cats = v.table("part").select((F.col("p_partkey") % 12).alias("c")).distinct().filter("c < 8")
    return cats.select(F.concat(F.lit("c"), "c").alias("model_label"), F.concat(F.lit("Label "), "c").alias("ui_label"))


@query("filter_regions", "select image_id, ann_id, round(score,9) as score, concat('Label ',substring(model_label,2)) as ui_label from v_dets where score>=0.4e0 and cast(substring(model_label,2) as int)<8")
def filter_regions(v):
    return rg.filter_regions(v.dets, class_map(v), 0.4).select("image_id", "ann_id", F.round("score", 9).alias("score"), "ui_label")


def prob_map(v):
    k = v.probs.select("label").distinct().filter("label <> 'L1'")
    return k.select(F.col("label").alias("model_label"), F.concat(F.lit("ui "), "label").alias("ui_label"))


@query("pick_choice", "select video_id, frame, concat('ui ',label) as choices, round(prob,9) as score from (select *, row_number() over(partition by video_id, frame order by prob desc, label_idx) rn from v_probs where label<>'L1') q where rn=1 and prob>=0.5e0")
def pick_choice(v):
    return rg.pick_choice(v.probs, prob_map(v), 0.5).withColumn("choices", F.array_join("choices", ",")).withColumn("score", F.round("score", 9))


@query("pick_choice_multi", "select video_id, frame, coalesce(string_agg(case when label<>'L1' then concat('ui ',label) end, ',' order by label_idx),'') as choices, round(avg(prob),9) as score from v_probs where prob>=0.5e0 group by video_id, frame having avg(prob)>=0.5e0")
def pick_choice_multi(v):
    return rg.pick_choice(v.probs, prob_map(v), 0.5, "multi").withColumn("choices", F.array_join("choices", ",")).withColumn("score", F.round("score", 9))


def keypoints(v):
    k = F.col("point_index")
    points = v.dets.select("image_id", F.col("ann_id").alias("bbox_index"), "x", "y", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("point_index"))
    return points.select("image_id", "bbox_index", "point_index", (((F.col("x") + F.col("y") * k) % 97) / 97).alias("conf"))


@query(
    "filter_keypoints",
    """with g as (select * from v_dets where score>=0.3e0 and cast(substring(model_label,2) as int)<8),
    p as (select g.image_id, g.ann_id as bbox_index, k as point_index, ((x+y*k)%97)/97e0 as conf, model_label from g, (select unnest(range(0,4)) as k) i)
    select image_id, ann_id as bbox_index, null as point_index, 'rectanglelabels' as type, model_label as label, concat('bbox-',ann_id) as region_id, null as parent_id, round(score,9) as score from g
    union all select image_id, bbox_index, point_index, 'keypointlabels', concat('pt ',model_label,' ',point_index), null, concat('bbox-',bbox_index), round(conf,9) from p where conf>=0.25e0 and point_index<3""",
)
def filter_keypoints(v):
    labels = class_map(v).select("model_label")
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    point_map = labels.select("model_label", k).select(F.concat_ws("::", "model_label", "k").alias("key"), F.concat(F.lit("pt "), "model_label", F.lit(" "), "k").alias("point_label"))
    dets = v.dets.withColumnRenamed("ann_id", "bbox_index")
    return rg.filter_keypoints(keypoints(v), dets, class_map(v), point_map, 0.3, 0.25).withColumn("score", F.round("score", 9))


@query("parent_regions", "select image_id, ann_id as bbox_index, k as point_index, concat('bbox-',ann_id) as parent_id from v_dets, (select unnest(range(0,4)) as k) i where score>=0.5e0")
def parent_regions(v):
    boxes = v.dets.filter("score >= 0.5").withColumnRenamed("ann_id", "bbox_index")
    return rg.parent_regions(keypoints(v), boxes).drop("conf")


@query("prediction_score", "select o_orderkey as task_id, coalesce(round(avg(score),9),0) as score from orders left join (select * from v_dets where score>=0.6e0) d on d.image_id=o_orderkey group by o_orderkey")
def prediction_score(v):
    tasks = v.table("orders").select(F.col("o_orderkey").alias("task_id"))
    regions = v.dets.filter("score >= 0.6").withColumnRenamed("image_id", "task_id")
    return rg.prediction_score(tasks, regions).withColumn("score", F.round("score", 9))


@query("least_confident", "select o_orderkey as task_id, coalesce(min(round(score,4)),2) as score from orders left join (select * from v_dets where score>=0.6e0) d on d.image_id=o_orderkey group by o_orderkey")
def least_confident(v):
    tasks = v.table("orders").select(F.col("o_orderkey").alias("task_id"))
    return rg.least_confident(tasks, v.dets.filter("score >= 0.6").withColumnRenamed("image_id", "task_id"))


@query("best_mask", "select image_id, model_label, ann_id, round(score,9) as score from (select *, row_number() over(partition by image_id, model_label order by score desc, ann_id) rn from v_dets) q where rn=1")
def best_mask(v):
    return rg.best_mask(v.dets, ["image_id", "model_label"], "ann_id").select("image_id", "model_label", "ann_id", F.round("score", 9).alias("score"))


# ---- texts ---------------------------------------------------------------

TOKENS = "(select doc_id, unnest(range(0,len(string_split(text,' ')))) as idx, unnest(string_split(text,' ')) as token from documents)"
OFFSETS = f"(select *, coalesce(sum(length(token)+1) over(partition by doc_id order by idx rows between unbounded preceding and 1 preceding),0) as off from {TOKENS} tk)"
SPANS = "(select doc_id, k as span_id, k*100+7 as start, least(k*100+20, length(text)) as fin, case k%2 when 0 then 'A' else 'B' end as label from (select doc_id, text, unnest(range(0, length(text)//100+1)) as k from documents) d where k*100+7<length(text))"


def spans(v):
    n, k = F.length("text").cast("bigint"), F.col("span_id")
    rows = v.table("documents").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(n / 100))).alias("span_id"))
    return rows.filter(k * 100 + 7 < F.col("n")).select(
        "doc_id", "span_id", (k * 100 + 7).alias("start"), F.least(k * 100 + 20, F.col("n")).alias("end"), F.when(k % 2 == 0, "A").otherwise("B").alias("label")
    )


@query(
    "keyword_spans",
    """with h as (select doc_id, unnest(range(0,len(hits))) as n, unnest(hits) as found, unnest(gaps[1:len(hits)]) as gap from (select doc_id, regexp_extract_all(text,'(?i)the') as hits, string_split_regex(text,'(?i)the') as gaps from documents) d),
    s as (select *, sum(length(gap)+length(found)) over(partition by doc_id order by n) as fin from h)
    select doc_id, cast(fin-length(found) as bigint) as start, cast(fin as bigint) as "end", found,
    round(((substring(found,1,1)='T')::int+(substring(found,2,1)='h')::int+(substring(found,3,1)='e')::int)/3e0,9) as score from s""",
)
def keyword_spans(v):
    return tx.keyword_spans(v.table("documents"), "The").withColumn("score", F.round("score", 9))


@query(
    "fill_span_gaps",
    f"""with s as (select * from {SPANS} q), g as (select doc_id, coalesce(lag(fin) over(partition by doc_id order by start),0) as a, start as b from s)
    select doc_id, start, fin as "end", label from s union all select doc_id, a, b, 'O' from g where b>a
    union all select d.doc_id, coalesce(m,0), length(text), 'O' from documents d left join (select doc_id, max(fin) as m from s group by doc_id) x on d.doc_id=x.doc_id where coalesce(m,0)<length(text)""",
)
def fill_span_gaps(v):
    return tx.fill_span_gaps(spans(v), v.table("documents"))


@query(
    "char_to_token_spans",
    f"""with o as (select doc_id, idx, off, count(*) over(partition by doc_id) as n from {OFFSETS} t), s as (select * from {SPANS} q)
    select s.doc_id, s.span_id, min(o.idx) filter (o.off>=s.start) as start_token, coalesce(min(o.idx) filter (o.off>=s.fin), max(o.n)) as end_token from s join o on o.doc_id=s.doc_id group by s.doc_id, s.span_id""",
)
def char_to_token_spans(v):
    return tx.char_to_token_spans_of_texts(v.table("documents"), spans(v))


@query(
    "bio_tags",
    f"""with o as (select * from {OFFSETS} t), s as (select * from {SPANS} q), i as (select o.doc_id, o.idx, s.label, row_number() over(partition by o.doc_id, s.start order by o.idx) rn from o join s on s.doc_id=o.doc_id and o.off>=s.start and o.off<s.fin)
    select o.doc_id, o.idx, md5(o.token) as token_md5, case when i.idx is null then 'O' when rn=1 then concat('B-',label) else concat('I-',label) end as tag,
    case when i.idx is null then 0 else (case label when 'A' then 2 else 4 end)-(case when rn=1 then 1 else 0 end) end as tag_id from o left join i on i.doc_id=o.doc_id and i.idx=o.idx""",
)
def bio_tags(v):
    tags = tx.bio_tags_of_texts(v.table("documents"), spans(v), ["A", "B"])
    return tags.select("doc_id", "idx", F.md5("token").alias("token_md5"), "tag", "tag_id")


@query(
    "align_subwords",
    f"""with t as (select doc_id, idx, (length(token)+3)//4 as np, idx%5 as tag from {TOKENS} k), p as (select doc_id, idx, tag, unnest(range(0,np)) as pc from t)
    select doc_id, row_number() over(partition by doc_id order by idx, pc) as pos, case when pc=0 then tag else -100 end as label from p
    union all select distinct doc_id, 0, -100 from t""",
)
def align_subwords(v):
    """A tokenizer's output, a special and then pieces of 4 characters of each word, beside the words' tags."""
    docs = v.table("documents").filter("text is not null").select("doc_id", F.split("text", " ").alias("_w"))
    pieces = F.transform("_w", lambda w, i: F.array_repeat(i, F.floor((F.length(w) + 3) / 4).cast("int")))
    words = F.concat(F.array(F.lit(None).cast("int")), F.flatten(pieces))
    return tx.align_subwords_of_texts(docs.select("doc_id", words.alias("words"), F.transform("_w", lambda w, i: i % 5).alias("tags")))


@query(
    "fuzzy_label",
    """with l as (select label, row_number() over(order by label) as ord from (select distinct p_type as label from part) p), n as (select distinct p_name as line from part),
    s as (select line, label, ord, round(1-levenshtein(line,label)*1e0/greatest(length(line),length(label)),9) as score from n cross join l)
    select line, label, score from (select *, row_number() over(partition by line order by score desc, ord) rn from s) q where rn=1""",
)
def fuzzy_label(v):
    labels = v.table("part").select(F.col("p_type").alias("label")).distinct()
    ordered = tx.number_rows(labels, [], ["label"], "ord")
    return tx.fuzzy_label(v.table("part").select(F.col("p_name").alias("line")), ordered).withColumn("score", F.round("score", 9))
