"""License scans: base phrases, and templates with optional and replaceable regions compiled into token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label -> template: <<optional>> ... <<end>> may be missing, <<any:N>> stands for up to N words, all else is mandatory.
TEMPLATES = {
    "mit-notice": "<<optional>>this software is<<end>> <<optional>>licensed<<end>> <<optional>>released<<end>> under the <<optional>>terms of the<<end>> MIT license",
    "apache-2-notice": "licensed under the Apache License Version 2.0 <<optional>>the License <<optional>>you may not use this file except in compliance with the License<<end>><<end>>",
    "cc-by-nc-notice": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> <<optional>>Creative Commons<<end>> CC BY NC <<optional>>4.0<<end>> <<optional>>3.0<<end>> <<optional>>license<<end>>",
    "mit-text": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions The above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the Software",
    "isc-text": "Permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any:2>> Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any:2>> Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl-notice": "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation <<optional>>either<<end>> version <<any:2>> <<optional>>of the License or at your option any later version<<end>>",
    "copyright-mit": "copyright <<any:12>> <<optional>>all rights reserved<<end>> <<optional>>licensed<<end>> <<optional>>released<<end>> under the MIT license",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = rb"[^0-9a-z\x80-\xff]+"


def words_of(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased: runs of digits, a-z and code points from x80."""
    return [m.decode() for m in _WORD.findall(text.encode().lower())]


@dataclass
class Automaton:
    """Nodes in order: ('word', w), ('any',). after: nodes reachable from a node without reading; accept: node count."""

    label: str
    nodes: list[tuple] = field(default_factory=list)
    jumps: dict[int, set[int]] = field(default_factory=dict)

    def closure(self, k: int) -> frozenset[int]:
        out, todo = set(), [k]
        while todo:
            i = todo.pop()
            if i not in out:
                out.add(i)
                todo += self.jumps.get(i, ())
        return frozenset(out)

    def seal(self) -> None:
        self.close = [self.closure(k) for k in range(len(self.nodes) + 1)]
        self.first = {self.nodes[k][1] for k in self.close[0] if k < len(self.nodes)}

    def find(self, words: list[str]) -> list[tuple[int, int]]:
        """(start, end) of accepted places, one for each start: the longest. Every state keeps all its starts apart by their order; a text of n words takes n steps of at most as many states as there are starts in flight."""
        end, found, live = len(self.nodes), {}, {}
        for at, w in enumerate(words):
            if w in self.first:
                for k in self.close[0]:
                    live.setdefault(k, set()).add(at)
            if not live:
                continue
            nxt: dict[int, set[int]] = {}
            for k, starts in live.items():
                if k < end and (self.nodes[k][0] == "any" or self.nodes[k][1] == w):
                    for j in self.close[k + 1]:
                        nxt.setdefault(j, set()).update(starts)
            for s in nxt.pop(end, ()):
                found[s] = at + 1
            live = nxt
        return sorted(found.items())


def compile_template(label: str, markup: str) -> Automaton:
    """Token automaton of a template. Raises ValueError for markup that does not nest, an unknown mark, or nothing mandatory."""
    a, open_ = Automaton(label), []
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<optional>>":
            open_.append(len(a.nodes))
        elif part == "<<end>>":
            if not open_:
                raise ValueError("<<end>> without <<optional>>")
            a.jumps.setdefault(open_.pop(), set()).add(len(a.nodes))
        elif m := re.fullmatch(r"<<any:(\d+)>>", part):
            start, n = len(a.nodes), int(m[1])
            for k in range(n):
                a.nodes.append(("any",))
                a.jumps.setdefault(start + k, set()).add(start + n)
        elif part.startswith("<<"):
            raise ValueError(f"unknown mark {part}")
        else:
            a.nodes += [("word", w) for w in words_of(part)]
    if open_:
        raise ValueError("<<optional>> without <<end>>")
    if any(k < len(a.nodes) and a.nodes[k][0] == "any" for k in a.closure(0)) or len(a.nodes) in a.closure(0):
        raise ValueError("a template starts with a word and has mandatory wording")
    a.seal()
    return a


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches):
        patterns = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + _GAP.join(w.encode() for w in p.split()) + rb"(?![0-9a-z\x80-\xff])"), label, p.split()) for p, label in phrases.items()]
        automata = [compile_template(k, v) for k, v in templates.items()]
        # a text without the rarest-looking mandatory word of a template cannot match it
        gates = [max((n[1] for n in _mandatory(a)), key=len).encode() for a in automata]
        is_word = np.zeros(256, bool)
        is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for t in batch.column(1):
                raw = (t.as_py() or "").encode().lower()
                mask = is_word[np.frombuffer(raw, np.uint8)]
                starts = mask.copy()
                starts[1:] &= ~mask[:-1]
                places, base, labels, spans = [], set(), set(), []
                for pattern, label, _ in patterns:
                    for m in pattern.finditer(raw):
                        places.append(m.start())
                        base.add(label)
                words = None
                for a, gate in zip(automata, gates, strict=True):
                    if gate in raw:
                        if words is None:
                            words = [w.decode() for w in _WORD.findall(raw)]
                        got = a.find(words)
                        if got:
                            labels.add(a.label)
                            spans += [{"label": a.label, "start": s, "end": e} for s, e in got]
                at = np.cumsum(starts)[places] - 1 if places else []
                cols["n_words"].append(int(starts.sum()))
                cols["n_base"].append(len(places))
                cols["first_word"].append(int(min(at)) if places else None)
                cols["last_word"].append(int(max(at)) if places else None)
                cols["base_labels"].append(",".join(sorted(base)))
                cols["labels"].append(",".join(sorted(base | labels)))
                cols["score"].append(1.0 if labels else 0.5 if base else 0.0)
                cols["spans"].append(spans)
            kinds = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items())], ["doc_id", *cols])

    return run


def _mandatory(a: Automaton) -> list[tuple]:
    """The word nodes that no jump passes over."""
    skipped = {i for s, ends in a.jumps.items() for e in ends for i in range(s, e)}
    return [n for i, n in enumerate(a.nodes) if n[0] == "word" and i not in skipped]


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row of docs (doc_id, text).

    Base: all places where a phrase's words stand one after another; first_word and last_word are their smallest and largest
    first words, null without any. A template's label is added when its automaton accepts a place: all mandatory words in order
    and nothing else between them than what its marks allow; spans has label, first word and the word after the last. score: 1
    if a template matched, 0.5 if only a phrase did, else 0. A null text counts as empty. Rows repeat as they came, null ids
    stay null, other columns are not read, an empty table gives no rows. Each row is worked on alone.
    """
    for label, markup in templates.items():
        compile_template(label, markup)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(_scan(phrases, templates), schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """`license_scan` with the number of template places in place of the spans."""
    return license_scan(docs).withColumn("n_places", F.size("spans").cast("long")).drop("spans")
