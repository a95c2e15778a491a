"""License scans by diagonal voting, with DataFrame operations only.

All rolling word k-grams of every whole text are joined by hash to the positions of the
template k-grams. Hits of a template at document word i and template word t lie on the
diagonal i - t; diagonals that lie next to each other (an inserted or left-out word or two)
are merged, and the merged span is verified: its hits are gone through in the order of the
document, and those that go on in the template count. A span is accepted if enough of the
template's k-grams are found in order. The join compares the words as well as their hash.

Defined results: null and empty texts have no words, no labels and score 0; a text of
fewer than k words has no k-grams. Repeated rows each get their own result, ties between
templates add all their labels, extra columns are not read. The templates are a fixed
table, whose size is checked before it is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The phrases whose every place is counted, with their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Widespread license notices, their opening words and their whole text, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license version": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
    to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
    and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
    the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
    the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
    fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or
    other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
    dealings in the software""": "mit",
    """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy
    of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
    the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the
    specific language governing permissions and limitations under the license""": "apache",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
    free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it
    will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
    general public license for more details""": "gpl",
    """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in
    binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
    materials provided with the distribution""": "bsd",
    """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
    copyright notice and this permission notice appear in all copies""": "isc",
    """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
    can obtain one at http mozilla org mpl 2 0""": "mpl",
}
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Template k-grams that may be broadcast, about 1 MB.
MOST_GRAMS = 20_000


def words_of(text: Column) -> Column:
    """The words, with A-Z in lower case; other letters' case doesn't matter to the templates."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "K", "ĸ")  # the Kelvin sign would become an ASCII k
    return F.regexp_extract_all(F.lower(plain), F.lit(WORDS), 0)


def templates(docs: DataFrame, phrases: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """A row a k-gram: template, whether it is a base phrase, label, k-grams of the template, place, words and their hash."""
    rows = []
    for n, (phrase, label) in enumerate([*phrases.items(), *notices.items()]):
        words = re.findall(WORDS, phrase)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {phrase!r}")
        rows += [(n, n < len(phrases), label, len(words) - k + 1, t, *words[t : t + k]) for t in range(len(words) - k + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; at most {MOST_GRAMS} are broadcast")
    own = [f"t{j}" for j in range(k)]
    return docs.sparkSession.createDataFrame(rows, "template int, base boolean, label string, grams int, t int, " + ", ".join(f"{c} string" for c in own)).withColumn("h", F.xxhash64(*own))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, k: int = 2, near: int = 2, enough: float = 0.85) -> DataFrame:
    """One row a document row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    k: words of a k-gram, at most those of the shortest template. spans holds each accepted
    span as (label, first word, last word, share of the template). One shuffle, of the hits
    and one row a document; the texts stay where they are read.
    """
    own = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), words_of(docs[text_col]).alias("words"))
    # place -1 stands for the document itself: it meets no template and is always kept
    places = own.select("id", "row", F.size("words").cast("bigint").alias("n_words"), "words", F.explode(F.expr("sequence(-1, size(words) - 1)")).alias("i"))
    said = [f"w{j}" for j in range(k)]
    grams = places.select("id", "row", "n_words", "i", *[F.when(F.col("i") >= 0, F.get("words", F.col("i") + j)).alias(c) for j, c in enumerate(said)])
    grams = grams.withColumn("key", F.when(F.col(said[-1]).isNotNull(), F.xxhash64(*said)))
    table = F.broadcast(templates(docs, phrases, notices, k))
    same = grams.key == table.h
    for j, c in enumerate(said):
        same &= grams[c] == table[f"t{j}"]
    hits = grams.join(table, same, "left").where("i = -1 or template is not null")
    hits = hits.select("id", "row", "n_words", "i", "template", "base", "label", "grams", "t", (F.col("i") - F.col("t")).alias("diagonal"))
    hits = hits.repartition("row")  # one document's hits meet here, and all that follows stays there

    each = ["row", "id", "n_words", "template", "base", "label", "grams"]
    along = Window.partitionBy(*each).orderBy("diagonal", "i")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.when(step.isNull() | F.when(F.col("base"), step > 0).otherwise(step > near), 1).otherwise(0)
    merged = hits.withColumn("apart", apart).withColumn("band", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max("t").over(Window.partitionBy(*each, "band").orderBy("i", "t").rowsBetween(Window.unboundedPreceding, -1))
    verified = merged.withColumn("goes_on", before.isNull() | (F.col("t") > before))
    spans = verified.groupBy(*each, "band").agg(
        F.min("i").alias("first"), (F.max("i") + k - 1).alias("last"), F.count(F.when(F.col("goes_on"), 1)).alias("found"),
    )
    share = F.col("found") / F.col("grams")
    fits = F.col("template").isNotNull() & F.when(F.col("base"), F.col("found") == F.col("grams")).otherwise(share >= enough)
    is_base = fits & F.col("base")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(fits).alias("labels"),
        F.coalesce(F.max(F.when(fits, share)), F.lit(0.0)).cast("double").alias("score"),
        F.array_sort(F.collect_list(F.when(fits, F.struct("label", "first", "last", share.alias("share"))))).alias("spans"),
    ).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
