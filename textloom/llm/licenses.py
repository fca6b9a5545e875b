"""License scan by diagonal voting.

Every rolling hash of ``K`` words of every text is joined in Spark with the
positions of the same hash in the license templates (a fixed table of a few hundred
rows, hence broadcast).  Hits vote for (document, template, offset diagonal);
neighbouring diagonals, which small insertions make, merge into one span; spans
with enough different template positions are verified word by word against the text:
the words that stand in order, by the longer of the template and the stretch they
take.  Base phrases are found in the same words, wherever they stand.

Spans to verify go back to their texts by a broadcast if they are at most
``BROADCAST_ROWS``, as counted, else by a join of both sides' exchanges.

Defined cases: null and empty texts have no words and no labels (first_word and
last_word null, score 0); repeated rows get equal rows, as votes count distinct
template positions; rows with a null doc_id get base labels only; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import ALNUM_WORDS, Words, blocks
from .shared import lean, stash, table

K, BROADCAST_ROWS = 5, 200_000
#: Phrases that name a license, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of the licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def _hashes(text: str, k: int | None = None) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), ALNUM_WORDS, lower=True)
    if k is None:
        return w.hash
    grams, ok = w.grams(k)
    return grams[ok]


def _base(batches):
    rules = [(_hashes(p), label) for p, label in PHRASES.items()]
    for rows, data, offs in blocks(batches):
        w = Words(data, offs, ALNUM_WORDS, lower=True)
        n = len(w.hash)
        doc, end = w.doc_of(), np.repeat(w.offs[1:], w.counts)
        places = []
        for rule, _ in rules:
            ok = w.hash == rule[0]
            for i in range(1, len(rule)):
                ok[: max(0, n - i)] &= w.hash[i:] == rule[i]
                ok[max(0, n - i) :] = False
            at = np.flatnonzero(ok)
            places.append(at[at + len(rule) <= end[at]])
        total, labels = np.zeros(len(w.counts), np.int64), [set() for _ in w.counts]
        first, last = [None] * len(labels), [None] * len(labels)
        for (_, label), at in zip(rules, places):
            for i, p in zip(doc[at].tolist(), (at - w.offs[doc[at]]).tolist()):
                total[i] += 1
                labels[i].add(label)
                first[i], last[i] = p if first[i] is None else min(first[i], p), p if last[i] is None else max(last[i], p)
        cols = [rows.column("doc_id"), rows.column("key"), pa.array(w.counts.astype(np.int64)), pa.array(total), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"])


def _grams(batches, k):
    for rows, data, offs in blocks(batches):
        w = Words(data, offs, ALNUM_WORDS, lower=True)
        grams, ok = w.grams(k)
        size = np.maximum(w.counts - k + 1, 0)
        grams = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(grams[ok].view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), grams], names=["doc_id", "key", "grams"])


def _likeness(have: list[bytes], want: list[bytes]) -> float:
    """How much of the template stands in order in the words, over the longer of it and the stretch taken; the best place counts."""
    n, best = len(want), 0.0
    for at in range(0, max(1, len(have) - n), n):  # a long chain of repeats is read a part at a time
        found = [b for b in difflib.SequenceMatcher(None, have[at : at + 2 * n], want, autojunk=False).get_matching_blocks() if b.size]
        if found:
            best = max(best, sum(b.size for b in found) / max(n, found[-1].a + found[-1].size - found[0].a))
    return best


def _verify(batches, texts, least):
    known = {name: words(text) for name, text in texts.items()}
    for batch in batches:
        score = []
        for text, name, first, last in zip(*(batch.column(c).to_pylist() for c in ("text", "template", "first", "last"))):
            score.append(_likeness(words(text)[max(0, first) : last], known[name]))
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("template"), batch.column("first"), batch.column("last"), pa.array(score, pa.float64())], names=["doc_id", "key", "template", "first", "last", "score"])
        yield out.filter(pa.array([s >= least for s in score], pa.bool_()))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, slack: int = 8, least: float = 0.8) -> DataFrame:
    """(doc_id, key, template, first, last, score): verified spans of words; docs: doc_id, key, text."""
    spark = docs.sparkSession
    texts = templates or TEMPLATES
    rows = [(name, p, int(h)) for name, text in texts.items() for p, h in enumerate(_hashes(text, k).view(np.int64).tolist())]
    size = {name: len(words(text)) for name, text in texts.items()}
    places = F.broadcast(spark.createDataFrame(rows, "template string, p int, gram long"))
    hits = docs.mapInArrow(partial(_grams, k=k), "doc_id long, key long, grams array<long>").select("doc_id", "key", F.posexplode("grams").alias("at", "gram")).join(places, "gram")
    diagonals = hits.groupBy("doc_id", "key", "template", (F.col("at") - F.col("p")).alias("diagonal")).agg(F.collect_set("p").alias("places"))
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    runs = diagonals.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= slack, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    length = F.element_at(F.create_map(*[F.lit(x) for kv in size.items() for x in kv]), F.col("template"))
    spans = (
        runs.groupBy("doc_id", "key", "template", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
        .filter(F.col("votes") >= F.greatest(F.lit(1), 0.4 * (length - k + 1)))
        .select("doc_id", "key", "template", F.col("low").cast("int").alias("first"), (F.col("high") + length).cast("int").alias("last"))
    )
    spans = stash(spans, "spans")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans.hint("merge")
    return docs.join(spans, ["doc_id", "key"]).select("doc_id", "key", "text", "template", "first", "last").mapInArrow(partial(_verify, texts=texts, least=least), "doc_id long, key long, template string, first int, last int, score double")


def scan_licenses(docs: DataFrame) -> DataFrame:
    lean(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    base = docs.mapInArrow(_base, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    label = F.regexp_replace("template", "-line$", "")
    found = license_spans(docs.filter("doc_id is not null and text is not null")).groupBy("doc_id", "key").agg(F.collect_set(label).alias("more"), F.max("score").alias("best"))
    joined = base.join(found, ["doc_id", "key"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
