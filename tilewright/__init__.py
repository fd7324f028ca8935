"""Dataset preparation for labelled imagery as Spark DataFrame operators."""
