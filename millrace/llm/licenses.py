"""Operator 4: license scans by an exact set-similarity join."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Shipped, table


@dataclass(frozen=True)
class Template:
    """A license text and its label.  ``phrase``: its words must also stand consecutively, and every such place
    is reported; else a block meets it if it holds a share of ``contained`` of its distinct words."""

    label: str
    text: str
    phrase: bool = False
    contained: float = 0.8

    @property
    def words(self) -> list[bytes]:
        return ALNUM.findall(self.text.encode().lower())


PHRASES = (Template("mit", "mit license", True, 1.0), Template("apache", "apache license", True, 1.0), Template("gpl", "general public license", True, 1.0))
#: Notices by which public licenses are commonly named or granted.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", contained=0.9),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", contained=1.0),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", contained=0.9),
)
#: Template words that may be broadcast: some 200 bytes each.
MAX_TEMPLATE_WORDS = 2_000_000
_MATCH = "array<struct<template:int,label:string,start:int,n_words:int,contained:double>>"
_SCAN = f"struct<n_words:long,places:array<struct<label:string,start:long>>,matches:{_MATCH}>"


class Matcher:
    """Template index over tokens in order of their frequency, rarest first."""

    def __init__(self, templates: Iterable[Template], counts: dict[bytes, int]):
        self.templates = list(templates)
        vocabulary = {w for t in self.templates for w in t.words}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.sets, self.need, self.index = [], [], {}
        longest = max((len(t.words) for t in self.templates), default=1)
        #: A block is two strides of words, so any passage as long as a template lies in one block whole.
        self.stride = max(32, longest)
        for k, t in enumerate(self.templates):
            own = sorted({self.rank[w] for w in t.words})
            need = math.ceil(t.contained * len(own) - 1e-9)
            self.sets.append(frozenset(own))
            self.need.append(need)
            for i, r in enumerate(own[: len(own) - need + 1]):
                self.index.setdefault(r, []).append((k, len(own) - i))
        self.prefix = {w for w, r in self.rank.items() if r in self.index}

    def scan(self, text: str | None) -> dict:
        words = ALNUM.findall((text or "").encode("utf-8", "surrogatepass").lower())
        places, matches = [], []
        prefix, stride = self.prefix, self.stride
        blocks = {b for i, w in enumerate(words) if w in prefix for b in (i // stride, i // stride - 1) if b >= 0}
        for b in sorted(blocks):
            lo, hi = b * stride, min((b + 2) * stride, len(words))
            block = sorted({self.rank[w] for w in words[lo:hi] if w in self.rank})
            seen: set[int] = set()
            for j, r in enumerate(block):
                for k, rest in self.index.get(r, ()):
                    # length filter, then positional filter at the first shared token of a pair
                    if k in seen or len(block) < self.need[k] or min(rest, len(block) - j) < self.need[k]:
                        continue
                    seen.add(k)
                    shared = len(self.sets[k].intersection(block))
                    if shared < self.need[k]:
                        continue
                    t = self.templates[k]
                    if t.phrase:
                        p = t.words
                        at = [i for i in range(lo, min(lo + stride, hi - len(p) + 1)) if words[i : i + len(p)] == p]
                        places += [{"label": t.label, "start": i} for i in at]
                    else:
                        matches.append({"template": k, "label": t.label, "start": lo, "n_words": hi - lo, "contained": shared / len(self.sets[k])})
        return {"n_words": len(words), "places": places, "matches": matches}


def token_counts(docs: DataFrame, templates: Iterable[Template], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates stands in all texts: at most one number for each such word."""
    vocabulary = {w for t in templates for w in t.words}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                if t:
                    n.update(w for w in ALNUM.findall(t.encode("utf-8", "surrogatepass").lower()) if w in vocabulary)
        yield pd.DataFrame({"w": list(n.keys()), "n": list(n.values())})

    got = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in got.collect()}


def scan(docs: DataFrame, templates: Iterable[Template] = PHRASES + NOTICES, text_col: str = "text", out_col: str = "_scan") -> DataFrame:
    """Add ``_scan``: a text's number of words, the places of its phrases, and the blocks that meet a notice.

    A text is read in overlapping blocks of words.  Blocks and templates are sets of tokens in order of their
    frequency in all texts, rarest first.  A block can only hold the needed number of a template's tokens if it
    holds one of the template's rarest (prefix filter), has enough tokens (length) and enough of both are left
    after the first shared one (position); pairs that pass are counted exactly, so every block that meets a
    template's containment is found.  Templates are a stated set of bounded size and are sent to the executors;
    texts are scanned where they are read.  Null and empty texts have no words; all rows and columns are kept.
    """
    templates = list(templates)
    if (n := sum(len(t.words) for t in templates)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{n} template words; call scan() with blocks of at most {MAX_TEMPLATE_WORDS}")
    matcher = Shipped(docs.sparkSession, Matcher(templates, token_counts(docs, templates, text_col)))

    @F.pandas_udf(_SCAN)
    def run(texts: pd.Series) -> pd.DataFrame:
        m = matcher.value
        return pd.DataFrame([m.scan(t) for t in texts], index=texts.index, columns=["n_words", "places", "matches"])

    return docs.withColumn(out_col, run(F.col(text_col)))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's license phrases and labels."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, found = F.col("_scan.places"), F.col("_scan.matches")
    labels = F.array_distinct(F.concat(base["label"], found["label"]))
    return out.select(
        "doc_id",
        F.col("_scan.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(found["contained"]), F.lit(0.0))).alias("score"),
    )
