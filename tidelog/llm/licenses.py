"""License scans by diagonal voting; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table, written

#: Separators between words, after lower-casing A-Z. Fixed by the result's contract.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base. Fixed by the result's contract.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Templates (label, text) whose spans are looked for beside the phrases: well-known openings, grants and conditions of common licenses,
#: the short notices that name a license, and whole licenses.
TEMPLATES = [
    ("mit", "the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "the bsd license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "mozilla public license 2 0"),
    ("isc", "the isc license"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    # Whole licenses.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    # Grants and notices.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "released under the gnu general public license v3"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form"),
]
#: Diagonals this near to one another are one span; a span counts from this share of its template's grams.
NEAR, LEAST = 3, 0.7
#: Places of a template in one bit mask; a longer template has several.
MASK = 64


def word_array(text: Column) -> Column:
    """Words of a text. A Kelvin sign would become an ASCII k, so it is set apart first; other letters keep to their side of ASCII."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00df")))
    return F.array_remove(F.split(low, BREAKS), "")


def grams(words: str) -> Column:
    """The word pairs (w0, w1) from each place on; the last pair's w1 is null."""
    return F.arrays_zip(F.col(words).alias("w0"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("w1"))


def positions(spark: SparkSession, phrases: list[tuple[str, str]], long: list[tuple[str, str]]) -> DataFrame:
    """(h, t0, t1, tid, tpos, label, base, size): every pair of every template; as many rows as the templates have words."""
    rows = []
    for tid, (text, label, base) in enumerate([(t, lab, True) for t, lab in phrases] + [(t, lab, False) for lab, t in long]):
        w = text.split()
        if len(w) < 2:
            raise ValueError(f"a template has 2 words at least: {text!r}")
        rows += [(w[i], w[i + 1], tid, i, label, base, len(w) - 1) for i in range(len(w) - 1)]
    t = spark.createDataFrame(rows, "t0 string, t1 string, tid int, tpos int, label string, base boolean, size int")
    return t.withColumn("h", F.xxhash64("t0", "t1"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, long: list[tuple[str, str]] = TEMPLATES, near: int = NEAR, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every pair of neighbouring words of every whole text is joined by hash to its places in the templates (and compared, so a hash
    collision gives no vote); votes are summed by diagonal, the text's place less the template's. A phrase stands where its diagonal has
    all its pairs. Diagonals of a longer template at most ``near`` apart are merged and are a span if together they have ``least`` of its
    pairs. score is the largest share of a span, 1 where a phrase stands, else 0. spans holds (label, base, first word, word after the last, share).

    A null text counts as empty: no words, null first_word and last_word, empty labels. Rows that repeat id and text get the same result each. A
    null id is an id like any other. Empty input: no rows. The templates are constants, so their table is broadcast. Votes are the one thing
    shuffled, once, by row: sums, neighbours and spans of a row are then worked out where its votes are.
    """
    places = max((len(t.split()) - 1 for t in [*(t for t, _ in phrases), *(t for _, t in long)]), default=1)
    masks = [f"mask{i}" for i in range(-(-places // MASK))]
    at = positions(docs.sparkSession, phrases, long)
    size = F.broadcast(at.filter("tpos = 0").select(F.col("tid").alias("of"), "label", "base", "size"))
    at = F.broadcast(at.select("h", "t0", "t1", "tid", "tpos"))
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), word_array(F.col("text")).alias("ws"))
    rows = rows.select("doc_id", "th", F.posexplode_outer(grams("ws")).alias("pos", "w")).select("doc_id", "th", "pos", F.col("w.w0").alias("w0"), F.col("w.w1").alias("w1"))
    rows = rows.withColumn("h", F.when(F.col("w1").isNotNull(), F.xxhash64("w0", "w1")))
    hits = rows.join(at, (rows["h"] == at["h"]) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")), "left")
    # A row's last pair, or its lack of pairs, has no template and stays: it says that the row is there and how long it is.
    hits = hits.filter("tid IS NOT NULL OR w1 IS NULL").select("doc_id", "th", "tid", "pos", "tpos").repartition("doc_id", "th")
    votes = hits.groupBy("doc_id", "th", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        *[F.bit_or(F.expr(f"if(coalesce(tpos, 0) div {MASK} = {i}, shiftleft(1L, coalesce(tpos, 0) % {MASK}), 0L)")).alias(m) for i, m in enumerate(masks)], F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")
    )
    by = Window.partitionBy("doc_id", "th", "tid").orderBy("diagonal")
    apart = (F.col("tid") < len(phrases)) | F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > near)
    runs = votes.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(by))
    spans = runs.groupBy("doc_id", "th", "tid", "run").agg(*[F.bit_or(m).alias(m) for m in masks], F.min("first").alias("first"), (F.max("last") + 1).alias("last"), F.max("n").alias("n"))
    spans = spans.join(size, F.col("tid") == F.col("of"), "left")
    share = sum((F.bit_count(m) for m in masks), F.lit(0)).cast("double") / F.col("size")
    spans = spans.withColumn("share", share).withColumn("ok", F.col("tid").isNotNull() & (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(least)))
    is_base = F.col("ok") & F.col("base")
    text = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "th").agg(
        F.max(F.when(F.col("tid").isNull(), F.coalesce(F.col("last"), F.lit(0)))).cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        text(is_base).alias("base_labels"),
        text(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("label", "base", "first", (F.col("last") + 1).alias("last"), "share")))).alias("spans"),
        F.max(F.when(F.col("tid").isNull(), F.col("n"))).cast("int").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("th", "copy", "copies")


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


_ALL = ", ".join(f"({i}, '{lab}', {base}, string_split('{t}', ' '))" for i, (t, lab, base) in enumerate([(t, lab, True) for t, lab in PHRASES] + [(t, lab, False) for lab, t in TEMPLATES]))
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(tid, label, base, tw) AS (VALUES {_ALL}),
g AS (SELECT tid, label, base, len(tw) - 1 AS size, i - 1 AS tpos, tw[i] AS w0, tw[i + 1] AS w1 FROM (SELECT *, unnest(range(1, len(tw))) AS i FROM t)),
p AS (SELECT doc_id, i - 1 AS pos, w[i] AS w0, w[i + 1] AS w1 FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT doc_id, tid, label, base, size, pos - tpos AS diagonal, pos, tpos FROM p JOIN g USING (w0, w1)),
v1 AS (SELECT DISTINCT doc_id, tid, base, diagonal FROM v),
v2 AS (SELECT *, CASE WHEN base OR lag(diagonal) OVER b IS NULL OR diagonal - lag(diagonal) OVER b > {NEAR} THEN 1 ELSE 0 END AS apart FROM v1 WINDOW b AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
r AS (SELECT doc_id, tid, diagonal, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS run FROM v2),
s AS (SELECT doc_id, tid, label, base, run, min(pos) AS first, count(DISTINCT tpos)::DOUBLE / size AS share FROM v JOIN r USING (doc_id, tid, diagonal) GROUP BY doc_id, tid, label, base, size, run),
ok AS (SELECT * FROM s WHERE share >= CASE WHEN base THEN 1.0 ELSE {LEAST} END),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (base), []))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score FROM ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id)
"""
