"""Text operators: exact round trips, brute force, held-out anchors, and odd texts."""

import json
import random

import pytest

from tracemill.llm import bpe, leakage, queries, reading
from tracemill.llm.notebooks import CODE, OUTPUT, TEXT, cells

RANKS = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = ["", "a  b", "x\x1c\x1d y", "  \xa0 z", "a\n\n  b\t\tc", "﻿ x", "é" * 300, "ab" * 5000, "\x85\x85 q", " " * 5000, "a   ", "\r\n\r\n x", "it's I'LL 'S", "0" * 3000, "<|endoftext|>", "\U0001f680" * 50, "a\x00b", "ﷺ" * 40, "iVBORw0KGgo" * 999]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS), queries.PATTERN)


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_odd_texts(encoder, reference):
    assert [encoder.encode(t) for t in ODD] == [reference(t) for t in ODD]
    assert [len(b) // 2 for b in encoder.encode_batch(ODD)] == [len(reference(t)) for t in ODD]


def test_random_texts(encoder, reference):
    hypothesis = pytest.importorskip("hypothesis")
    st = hypothesis.strategies

    @hypothesis.settings(max_examples=400, deadline=None)
    @hypothesis.given(st.text(max_size=60) | st.text(alphabet=" \n\t\xa0 \x1c\x85ab1'.é", max_size=40))
    def check(text):
        assert encoder.encode(text) == reference(text)

    check()


def test_tree_and_forest_agree(encoder):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdehilnorst AZ09\xc3\xa9") for _ in range(rng.randrange(1, 65))) for _ in range(500)]
    trees = [bpe.MergeTree([bytes([b]) for b in w], encoder.ranks).run() for w in words]
    import numpy as np

    forest = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.forest.run(words, 64, encoder.dtype)]
    assert forest == trees


def test_encoded_corpus(spark, reference):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(None, "x y", "c"), (0, None, "c"), (0, None, "c")]
    got = bpe.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), RANKS, queries.PATTERN).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), reference(t) if t else []) for k, t, _ in rows)
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, queries.PATTERN).count() == 0


NOTEBOOK = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "one é"]}, {"cell_type": "code", "source": "x = 1", "outputs": [{"output_type": "stream", "text": ["a\n", "b"]}, {"data": {"image/png": "AAAA", "text/plain": "fig"}}, {"traceback": ["\x1b[31mErr\x1b[0m"], "evalue": "e"}]}]}


def test_cells():
    text = json.dumps(NOTEBOOK)
    parts = [(TEXT, "# T\none é"), (CODE, "x = 1"), (OUTPUT, "a\nb"), (OUTPUT, "fig"), (OUTPUT, "Err")]
    assert cells(text, "ipynb") == parts
    assert cells(text[:-4], "ipynb") == parts
    cut = cells(text[: text.index("x = 1") + 3], "ipynb")
    assert cut == [(TEXT, "# T\none é"), (CODE, "x =")]
    assert cells("# %% [markdown]\n# # T\n# one\n\n# %%\nx = 1\n\n# > out\n# > two\n", "percent") == [(TEXT, "# T\none\n"), (CODE, "x = 1\n"), (OUTPUT, "out\ntwo"), ]
    assert cells("# T\r\n\r\nIn [1]:\r\nx\r\n\r\nOut:\r\n7", "plain") == [(TEXT, "# T"), (CODE, "\nx"), (OUTPUT, "\n7")]
    assert cells("a\n```python\nx\n```\nb\n```text\n7\n", "md") == [(TEXT, "a"), (CODE, "x"), (TEXT, "b"), (OUTPUT, "7\n")]
    for nb_format in ("ipynb", "percent", "plain", "md", None, "other"):
        for odd in ODD:
            assert isinstance(cells(odd, nb_format), list)
    assert cells(None, "md") == [] and cells("{}", "ipynb") == [(TEXT, "{}")]


def brute_force(items, docs):
    found = set()
    for item, text in items:
        own = leakage.words(text or "")
        size = min(12, len(own))
        for doc, body, nb_format in docs:
            words = leakage.words("\n".join(x for _, x in cells(body, nb_format)))
            if size and any(own[i:i + size] == words[j:j + size] for i in range(len(own) - size + 1) for j in range(len(words) - size + 1)):
                found.add((item, doc))
    return found


def test_leaks(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([1, 2, 4, 5, 7, 11, 12, 13, 30, 60])] + [(10, None), (11, ""), (12, "--"), (13, "Straße É w1")]
    docs = []
    for k in range(60):
        words = some(rng.randrange(0, 60))
        _, text = rng.choice(items[4:10])
        own = text.split()
        n, at = rng.choice([11, 12, 13, 40]), rng.randrange(len(own))
        words[5:5] = own[at:at + n]
        docs.append((k, rng.choice([" ", ",\n# > ", "​; "]).join(w.upper() if rng.random() < 0.3 else w for w in words), "plain"))
    docs += [(60, None, "md"), (61, "", "md"), (62, "straße é w1", None), (62, "straße é w1", None), (63, "x " * 50_000, "md")]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string, nb_format string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute_force(items, docs)
    for block in (8 << 20, 400):
        monkeypatch.setattr(leakage, "BLOCK_BYTES", block)
        got = [tuple(r) for r in leakage.leaked(*frames).collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert leakage.leaked(frames[0], frames[1].limit(0)).count() == 0 and leakage.leaked(frames[0].limit(0), frames[1]).count() == 0


def test_leaks_of_repetitive_texts():
    import numpy as np

    rng = random.Random(9)
    some = lambda n: [rng.choice("abc") for _ in range(n)]
    for _ in range(40):
        items = [(k, some(rng.choice([1, 3, 6, 11, 12, 13, 40]))) for k in range(12)]
        texts = [some(rng.randrange(80)) + (rng.choice(items)[1] * rng.randrange(3)) for _ in range(6)]
        index = leakage.ContainmentIndex(items)
        margin, ids, owners = [0] * leakage.PASSAGE, [], []
        for k, text in enumerate(texts):
            ids += [index.ids.get(w, 0) for w in text] + [0]
            owners += [k] * (len(text) + 1)
        got = index.search(np.array(margin + ids + margin, np.int32), np.array([-1] * len(margin) + owners + [len(texts)] * len(margin)))
        assert got == brute_force([(k, " ".join(own)) for k, own in items], [(k, " ".join(text), None) for k, text in enumerate(texts)])


def test_levels_of_anchors_held_out(spark):
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    anchors = spark.read.parquet(f"{d}/reading_anchors.parquet").collect()
    rows = [(a.anchor_id, a.text, "none") for a in anchors]
    train, held = [a for a in anchors if a.anchor_id % 8 < 4], [a for a in anchors if a.anchor_id % 8 >= 4]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, nb_format string")
    scale = spark.createDataFrame([(a.text, a.level) for a in train], "text string, level int")
    got = {r.doc_id: r.level for r in reading.reading_levels(docs, scale).collect()}
    right = sum(got.get(a.anchor_id) == a.level for a in held)
    assert right >= 0.9 * len(held)
    assert reading.reading_levels(docs, scale.limit(0)).count() == 0


def test_prose():
    text = "# Title\n\nWe compared the river. It was early.\n\nWenn die Spalte leer ist, zeigt die Zeile nichts.\n\n```python\nthe = is\n```\n\n![x](data:image/png;base64,AAAA) <b " + "x" * 5000 + ">"
    assert [(" ".join(w), n) for w, n in reading.prose(text, "md")] == [("we compared the river it was early", 2), ("wenn die spalte leer ist zeigt die zeile nichts", 1)]
    for odd in ODD:
        reading.prose(odd, "md")
    assert reading.prose(None, "md") == []


def test_languages_are_told_apart():
    english = "we compared the river with the garden and drew a line|it was early and the chart was empty|they read the table before the rain".split("|")
    german = "wenn die spalte leer ist zeigt die zeile nichts|danach liest die woche jede messung und schreibt sie auf|der garten war leer und die tabelle auch".split("|")
    texts = lambda x: [t.split() for t in x]
    # a label that misleads, and one that is spelled otherwise
    model = reading.fit_languages([("en", texts(english)), ("de", texts(german)), ("de", texts(english[:1])), ("eng", texts(english[1:]))], texts(english))
    assert model.own[model.best(texts(["the garden was empty and they drew it", "die tabelle ist leer und der garten auch", "表は空です 次の行を読む"]))].tolist() == [True, False, False]
    alone = reading.fit_languages([], texts(english))
    assert alone.own[alone.best(texts(["the river was early", "次の行を読む"]))].tolist() == [True, False]


def test_ranks_beyond_the_broadcast_words(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 4, 45]))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([5, 50, 400])]) for _ in range(60)) + "." for _ in range(80)]
    docs = spark.createDataFrame([(k % 70, t + "\n\n" + texts[k - 1], "none") for k, t in enumerate(texts)] + [(99, None, "md"), (98, "", "md"), (97, "x", "md")], "doc_id bigint, text string, nb_format string")
    anchors = spark.createDataFrame([(t, k % 2 + 1) for k, t in enumerate(texts[:20])], "text string, level int")
    got = [sorted(map(tuple, reading.reading_levels(docs, anchors).collect()))]
    for words in (30, 0):
        monkeypatch.setattr(reading, "HEAD_WORDS", words)
        got.append(sorted(map(tuple, reading.reading_levels(docs, anchors).collect())))
    assert len(got[0]) == 80 and got[0] == got[1] == got[2]
    counts = {}
    for t in texts:
        for w in t.rstrip(".").split() * 2:
            counts[w] = counts.get(w, 0) + 1
    rank = {w: sum(m >= n for m in counts.values()) for w, n in counts.items()}
    expected = sorted((k % 70, sorted(rank[w] for w in (t + texts[k - 1]).replace(".", " ").split())[95]) for k, t in enumerate(texts))
    assert sorted((r[0], r[3]) for r in got[0]) == expected
