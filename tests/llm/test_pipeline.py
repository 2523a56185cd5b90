"""The whole pipeline against a plain version in Python, on the smallest table."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import numpy as np
import tiktoken

import corpus_pipeline
import public_tokenizers
from panelmill.llm import language_id
from panelmill.llm.queries import tokenizer_file

SF_DIR = "/root/testdata/sf0.001"


def lowered(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def without_lines(docs: dict[int, str]) -> dict[int, str]:
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    seen: dict[str, set[int]] = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            seen.setdefault(key(line), set()).add(i)
    often = {k for k, ids in seen.items() if k and len(ids) >= 10}
    return {i: "\n".join(x for x in text.split("\n") if key(x) not in often) for i, text in docs.items()}


def one_of_each(docs: dict[int, str]) -> dict[int, str]:
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) for i, t in docs.items()}
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in docs}
    links = [(a, b) for a, b in itertools.combinations(sorted(docs), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in docs:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return {i: t for i, t in docs.items() if root[i] == i}


def without_items(docs: dict[int, str], items: list[str]) -> dict[int, str]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {tuple(w[j:j + 13]) for w in map(split, items) if w for j in range(max(1, len(w) - 12))}
    kept = {}
    for i, text in docs.items():
        w, hit = split(text), set()
        for size in {len(x) for x in windows}:
            hit |= {p for j in range(len(w) - size + 1) if tuple(w[j:j + size]) in windows for p in range(j, j + size)}
        if not hit or 20 * len(hit) < len(w):
            kept[i] = text
    return kept


def test_pipeline_against_plain_python(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    known = {r.doc_id for r in language_id.identify(table).filter("lang_pred <> 'und' and score >= 0.2").collect()}
    docs = {r.doc_id: r.text or "" for r in table.collect() if r.doc_id in known}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = without_items(one_of_each(without_lines(docs)), items)
    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i, text in docs.items():
        ids = library.encode_ordinary(text)
        expected[i] = (ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: (r["ids"], r.ids_sha256, r.decoded_sha256) for r in rows} == expected
    assert len(rows) == len(expected)


def test_clean_documents_are_kept(spark):
    """What goes has a reason: of the documents, most stay, and none goes for its language but those without letters."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language_id.in_known_language(table).count() == table.filter("text rlike '[A-Za-z]'").count()
