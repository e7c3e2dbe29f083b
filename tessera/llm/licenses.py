"""License scans by diagonal voting over rolling word k-gram hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Phrases that are counted wherever their words stand consecutively, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices whose spans may differ a little, with labels of their own.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
}
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a gram; diagonals this near are merged; share of a notice's grams that its span must hold.
K, NEAR, SHARE = 2, 3, 0.8


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case.

    lower() changes other letters as well, which no phrase has; only two letters become ASCII by it, and
    texts with those go the slow way.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    low = F.when(odd, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.filter(F.split(low, GAP), lambda w: w != "")


def templates(spark: SparkSession, base: dict, notices: dict) -> DataFrame:
    """(tpl, is_base, label, grams, tpl_pos, first, second, gram): a row for each gram of each phrase."""
    rows = []
    for n, (phrase, label, is_base) in enumerate([*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in notices.items())]):
        w = phrase.split()
        rows += [(n, is_base, label, len(w) - K + 1, i, w[i], w[i + 1]) for i in range(len(w) - K + 1)]
    t = spark.createDataFrame(rows, "tpl int, is_base boolean, label string, grams int, tpl_pos int, first string, second string")
    return t.withColumn("gram", F.xxhash64("first", "second"))


def spans(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): n_words and number of rows of each (doc_id, digest), and the spans found there.

    Every gram of every text is joined to the places it has in the phrases (a fixed table, so it is
    broadcast); matches are counted by diagonal, the difference of the places in text and
    phrase. A base phrase stands where a diagonal has all its grams. Of notices, neighbouring diagonals
    are merged, since words left out or put in move the rest, and a span stands if it
    holds SHARE of the notice's grams within about its length.
    """
    tpl = templates(docs.sparkSession, base, notices)
    w = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    rolled = F.zip_with("w", F.slice("w", K, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    # first a place of no gram, which carries the text itself
    grams = w.select("doc_id", "digest", "w", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.slice(rolled, 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("place", "g"))
    same = (F.col("g") == F.col("gram")) & (F.col("place") > 0) & (F.get("w", F.col("place") - 1) == F.col("first")) & (F.get("w", F.col("place")) == F.col("second"))
    hits = grams.join(F.broadcast(tpl), same, "left").where("place = 0 OR tpl IS NOT NULL")
    n = F.when(F.col("place") == 0, F.size("w").cast("long"))
    hits = hits.select("doc_id", "digest", n.alias("n_words"), "tpl", "is_base", "label", "grams", "tpl_pos", (F.col("place") - 1).alias("pos"))
    hits = written(hits)  # texts are read once, for what three aggregates read
    key = ["doc_id", "digest"]
    texts = hits.where("n_words IS NOT NULL").groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").alias("rows"))
    votes = hits.where("tpl IS NOT NULL").groupBy(*key, "tpl", "is_base", "label", "grams", (F.col("pos") - F.col("tpl_pos")).alias("diagonal"))
    votes = votes.agg(F.count_distinct("tpl_pos").alias("votes"), F.collect_set("tpl_pos").alias("held"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    exact = votes.where("is_base AND votes = grams").select(*key, "is_base", "label", F.col("diagonal").alias("start"), (F.col("grams") + K - 1).alias("length"), F.lit(1.0).alias("similarity"))
    along = W.partitionBy(*key, "tpl").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= NEAR, 0).otherwise(1)
    merged = votes.where("NOT is_base").withColumn("step", step).withColumn("run", F.sum("step").over(along))
    merged = merged.groupBy(*key, "tpl", "label", "grams", "run").agg(F.flatten(F.collect_list("held")).alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    similarity = F.size(F.array_distinct("held")) / F.col("grams")
    length = F.col("hi") - F.col("lo") + K
    near = merged.select(*key, F.lit(False).alias("is_base"), "label", F.col("lo").alias("start"), length.alias("length"), similarity.alias("similarity"), "grams")
    near = near.where((F.col("similarity") >= SHARE) & (F.col("length") <= (F.col("grams") + K - 1) * 1.25 + 1)).drop("grams")
    return texts, exact.unionByName(near)


def scan(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start; labels
    adds those of notices. score is the largest similarity of a span, 0 without one. Null texts count as
    empty. Repeated rows each get a row; a null doc_id keeps its row.
    """
    texts, found = spans(docs, base, notices)
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    is_base = F.col("is_base")
    by_text = found.groupBy("doc_id", "digest").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        names(F.when(is_base, F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"),
        F.max("similarity").alias("score"),
    )
    t, b = texts.alias("t"), by_text.alias("b")
    on = F.col("t.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t.digest") == F.col("b.digest"))
    out = t.join(b, on, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    kept = {c: F.coalesce(c, z) for c, z in zero.items()}
    return out.select("t.doc_id", "n_words", kept["n_base"].alias("n_base"), "first_word", "last_word", *(kept[c].alias(c) for c in ("base_labels", "labels", "score")))
