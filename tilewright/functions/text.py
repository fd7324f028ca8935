"""Text, URL, name and version helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.hashing import as_col


def strip_quotes(text) -> Column:
    return F.regexp_replace(as_col(text), r'^"+|"+$', "")


def coerce_text(text) -> Column:
    """Text without outer quotes; whole numbers lose leading zeros like an integer would."""
    t = as_col(text)
    number = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint").cast("string"))
    return F.coalesce(number, strip_quotes(t))


def coerce_list(values) -> Column:
    """A list counts as its first element."""
    return coerce_text(F.get(as_col(values), F.lit(0)))


def local_path_from_url(url) -> Column:
    """Path after `?d=`, with a leading slash."""
    return F.concat(F.lit("/"), F.get(F.split(as_col(url), r"\?d="), F.lit(1)))


def needs_preload(url) -> Column:
    """Uploads, served local files, cloud storage, and anything with scheme and host."""
    u = as_col(url)
    bare = u.startswith("upload") | u.startswith("/upload")
    full = F.when(bare, F.concat(F.lit("/data"), F.when(u.startswith("/"), "").otherwise("/"), u)).otherwise(u)
    cloud = full.startswith("s3:") | full.startswith("gs:") | full.startswith("azure-blob:")
    web = full.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    return full.startswith("/data/upload") | (full.startswith("/data/") & full.contains("?d=")) | cloud | web


def safe_name(text) -> Column:
    return F.translate(as_col(text), "/\\", "__")


def comma_items(text) -> Column:
    """Trimmed non-empty items of a comma list."""
    return F.filter(F.transform(F.split(as_col(text), ","), lambda p: F.trim(p)), lambda p: p != "")


def run_name(params, exclude: Sequence[str] = ()) -> Column:
    """`k=v-k=v` in key order, some keys left out."""
    entries = F.array_sort(F.map_entries(as_col(params)))
    if exclude:
        entries = F.filter(entries, lambda e: ~e["key"].isin(list(exclude)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "-")


def parse_run_name(name) -> Column:
    """Back to a map; a part without exactly one `=` (a value with `-`) is an error."""
    n = as_col(name)
    good = F.forall(F.split(n, "-"), lambda p: F.size(F.split(p, "=")) == 2)
    return F.when(good, F.str_to_map(n, F.lit("-"), F.lit("="))).otherwise(F.raise_error(F.concat(F.lit("bad run name: "), n)))


def error_fields(body, message: str) -> Column:
    """Type, message, code of an API error body and the composed text."""
    err = F.from_json(
        as_col(body), "error struct<type:string,message:string,error_user_msg:string,code:bigint>", {"mode": "PERMISSIVE"}
    )["error"]
    text = F.coalesce(F.nullif(err["message"], F.lit("")), err["error_user_msg"])
    full = F.concat(
        F.lit(message),
        F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(": "), text)).otherwise(""),
        F.when(F.coalesce(err["type"], F.lit("")) != "", F.concat(F.lit(" (type: "), err["type"], F.lit(")"))).otherwise(""),
        F.when(F.coalesce(err["code"], F.lit(0)) != 0, F.concat(F.lit(" [code: "), err["code"].cast("string"), F.lit("]"))).otherwise(""),
    )
    return F.struct(err["type"].alias("error_type"), text.alias("error_message"), err["code"].alias("error_code"), full.alias("full_message"))


def render_prompt(template: str, fields: dict[str, Column]) -> Column:
    """Replace `{field}` marks of a template."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def model_version(version) -> Column:
    """struct(name, major, minor, patch) of `name-vX.Y.Z` or `X.Y.Z`."""
    v = as_col(version)
    part = lambda i: F.regexp_extract(v, r"v?(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    return F.struct(
        F.regexp_replace(v, r"-?v?\d+\.\d+\.\d+$", "").alias("name"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")
    )


def bump_version(version, part: str = "minor") -> Column:
    """Version text with one part raised and the lower ones set to 0."""
    v = model_version(version)
    parts = ["major", "minor", "patch"]
    at = parts.index(part)
    nums = [v[p] if i < at else v[p] + 1 if i == at else F.lit(0) for i, p in enumerate(parts)]
    text = F.concat_ws(".", *[n.cast("string") for n in nums])
    return F.when(v["name"] != "", F.concat(v["name"], F.lit("-v"), text)).otherwise(text)


def stamp_version(stored, current) -> Column:
    """Predictions without a version get the model's."""
    return F.coalesce(as_col(stored), as_col(current))


def similarity(a, b) -> Column:
    """1 - edit distance / longer length."""
    a, b = as_col(a), as_col(b)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest
