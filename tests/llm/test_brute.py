"""Operators against plain versions of themselves, a library, or held-out labels."""

import hashlib
import itertools
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest
import xxhash
from oracle import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from chainlake.llm import langid, licenses, pii, piece_bpe, queries, secret_scan, simhash, winnowing
from chainlake.llm.components import connected_components

RND = random.Random(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_pieces_equal_the_library(library):
    model = piece_bpe.load(queries.model_path())
    parts = list("aehtionrs  \n▁é日😀\x00<>0x1_'.A") + ["the", " ", "in"]
    texts = ["", " ", "▁", "  a", "a  ", "<s>", "x" * 700, "ab" * 900, " " * 60, "日本" * 400, "\U0010ffff"]
    texts += ["".join(RND.choices(parts, k=RND.randint(0, 60))) for _ in range(2000)]
    for _ in range(2):  # the second time from memory
        ids, counts = model.encode_batch(texts)
        ends = np.cumsum(counts)
        back = model.decode_batch(ids, counts)
        for i, want in enumerate(library.encode(texts)):
            assert ids[ends[i] - counts[i] : ends[i]].tolist() == want
            assert back[i].decode() == library.decode(want)
    model.forget()
    assert model.encode_batch(texts)[0].tolist() == ids.tolist()


def test_op4(spark, sf_dir, docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op4_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids))


def test_decode_column(spark):
    rows = spark.createDataFrame([(1, "a  b é😀"), (2, None)], "doc_id int, text string")
    coded = piece_bpe.encode(rows, queries.model_path()).drop("decoded")
    assert {r.doc_id: r.decoded for r in piece_bpe.decode(coded, queries.model_path()).collect()} == {1: "a  b é😀", 2: ""}


# SimHash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_fingerprints(docs):
    texts = [d.text for d in docs.values()][:60] + ["", "One", "a b", "a b c", "ÄÖ a b c x", "a\x0bb\x1cc d e"] + ["x y z " * 900]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_op5(spark, sf_dir, docs):
    prints = {i: slow_fingerprint(d.text or "") for i, d in docs.items()}
    want = slow_components(prints)
    for r in queries.op5_simhash(spark, sf_dir).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("bucket", [1, 4, 10_000])
def test_links_of_dense_groups(spark, bucket):
    """Chains and clusters of near fingerprints, through pairs, through shared places, and both."""
    prints = set()
    for _ in range(6):
        x = RND.getrandbits(64)
        for _ in range(40):
            prints.add(x)
            for b in RND.sample(range(64), RND.choice((1, 2, 2, 3))):
                x ^= 1 << b
    prints = {i: x - 2**64 if x >= 2**63 else x for i, x in enumerate(sorted(prints))}
    frame = spark.createDataFrame([(x,) for x in prints.values()], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame, bucket=bucket), "a", "b").collect()}
    want = slow_components(prints)
    groups = lambda of: sorted(sorted(g) for g in of)
    by = {}
    for i, x in prints.items():
        by.setdefault(roots.get(x, x), []).append(i)
    own = {}
    for i, c in want.items():
        own.setdefault(c, []).append(i)
    assert groups(by.values()) == groups(own.values())


def test_pigeonring_keeps_every_near_pair():
    """Any two bits leave a start whose chains are within their budgets."""
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        differ = (1 << i) | (1 << j)
        octets = [differ >> (8 * s) & 255 for s in range(8)]
        assert any(
            all(sum(bin(octets[(s + t) % 8]).count("1") for t in range(n)) <= simhash.budget(n) for n in range(1, 9)) for s in range(8)
        )


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (7, 7), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# Spans


def slow_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def slow_secrets(text):
    assign = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def random_texts(parts, n):
    return ["".join(RND.choices(parts, k=RND.randint(0, 40))) for _ in range(n)]


def test_pii_patterns(docs):
    parts = list("a@.-+ 0123459()é\n") + ["4539578763621486", "1.2.3.4", "x@y.com", "+1 (555) 123-4567", "256."]
    for t in [d.text or "" for d in docs.values()] + random_texts(parts, 4000) + ["1" * 6000 + ".1.1.1"]:
        if len(t) < 6000 or "1" * 5000 not in t:
            assert sorted(pii.base_spans(t)) == slow_pii(t)
    assert pii.base_spans("0" * 6000 + "1.1.1.1")[0][1] == 1


def test_secret_patterns(docs):
    parts = list("a=:\"' 0f.-é\n") + ["token", "API_KEY", "ſecret", "password", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567"]
    for t in [d.text or "" for d in docs.values()] + random_texts(parts, 4000):
        assert sorted(secret_scan.base_spans(t)) == slow_secrets(t)


def test_constants_reach_sensitive_names():
    text = 'part = "Zx81kQ"\nclient_secret_value = part + "99aPq7Lm2"\nprivateKey: Qm9vZ1Jhbk82NDdhc2Qx\ncolour = "Zx81kQ99aPq7Lm2x"\npwd = "${PWD}"\n'
    found = {text[a:b] for a, k, b in secret_scan.spans(text) if k == 3}
    assert found == {'part + "99aPq7Lm2"', "Qm9vZ1Jhbk82NDdhc2Qx"}
    assert secret_scan.name_weight("dbPassword") == 1.0 and secret_scan.name_weight("monkey") == 0.0


S = "Zx81kQ99aPq7Lm2x"
FORMS = [
    f'pwd: str = "{S}"', f'const passphrase: string = "{S}";', f'const pwd string = "{S}"', f'var pwd = "{S}"', f'login: pwd = "{S}"',
    f'cfg["pwd"] = "{S}"', f"cfg['pwd'] = '{S}'", f'char pwd[] = "{S}";', f'char pwd[32] = "{S}";', f"const pwd = `{S}`;",
    f'pwd = f"{S}"', f'pwd = rb"{S}"', f'pwd = os.getenv("A", "{S}")', f'pwd := env.Get("A", `{S}`)', f'pwd: Optional[str] = "{S}"',
    f'let pwd: &str = "{S}";', f'pwd: str | None = "{S}"', f'pwd = x["pwd"] = "{S}"', f'connect(user="a", pwd="{S}")',
    f'a = open(pwd="{S}")', f'"pwd": "{S}"', f"pwd => '{S}'", f"pwd: {S}", f'a: b: pwd = "{S}"', f'String pwd = "{S}";',
    f'pwd = getenv(\n  "A",\n  "{S}"\n)', f'pwd?: string = "{S}"', f'pwd = str(os.getenv("A", "{S}"))', f'{{"user": "x", "pwd": "{S}"}}',
]


@pytest.mark.parametrize("form", FORMS)
def test_assignment_forms(form):
    for text in (form, f"é😀 x = 1\n{form}\ny = 2\n"):
        found = [text[a:b] for a, k, b in secret_scan.spans(text) if k == 3]
        assert len(found) == 1 and found[0].strip("frb\"'`") == S


@pytest.mark.parametrize("form", [f'note: colour = "{S}"', f'pwd == "{S}"', f'pwd = os.getenv("A")', f'pwd = load(name="{S}")', f'pwd = 1\nx = "{S}"'])
def test_not_assigned_to_a_secret_name(form):
    assert not [1 for _, k, _ in secret_scan.spans(form) if k == 3]


def test_lexer_takes_time_in_proportion():
    for part in ("x = f(", '"x": f(', "x[1] = f(", "a: ", 'k="', "pwd: A[a,", "`", "a.b", "x y = ", "f(\"a\", "):
        start = time.process_time()
        secret_scan.spans(part * 40_000)
        assert time.process_time() - start < 10


def test_op2_op7(spark, sf_dir, docs):
    for name, slow, kinds in (("op2_pii_scan", slow_pii, pii.KINDS), ("op7_secret_scan", slow_secrets, secret_scan.BASE_KINDS)):
        for r in queries.QUERIES[name](spark, sf_dir).collect():
            base = [f"{kinds[k]}:{a}:{b}" for a, k, b in slow(docs[r.doc_id].text or "")]
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert set(base) <= set(filter(None, r.spans.split(",")))
            assert [r[f"n_{k}"] for k in kinds] == [sum(b.startswith(k + ":") for b in base) for k in kinds]


def test_skip_links_make_labels_agree():
    field = pii.Field().fit([f"call +1 (555) 123-45{i:02d} or mail a{i}@b.org from 10.0.0.{i} now 12 or 3" for i in range(60)])
    alone, linked = field.beliefs([["10.0.0.999"]])[0], field.beliefs([["10.0.0.9", "7", "10.0.0.9"]])
    assert linked[0].argmax() == linked[2].argmax() == 2 and len(alone) == 5
    assert pii.edges(["x1", "y2", "x1", "z3", "x1"])[1] == [(0, 2), (2, 4)]


# Winnowing


def slow_winnow(text, k=winnowing.K, window=winnowing.WINDOW):
    points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
    k = min(k, len(points))
    hashes = []
    for i in range(len(points) - k + 1 if k else 0):
        h = 0
        for p in points[i : i + k]:
            h = (h * winnowing._BASE + p) % 2**64
        hashes.append(((h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64) >> 32)
    window = min(window, len(hashes))
    out = []
    for i in range(len(hashes) - window + 1 if hashes else 0):
        least = min(hashes[i : i + window])
        at = max(j for j in range(i, i + window) if hashes[j] == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


def test_winnow(docs):
    texts = ["", "a", "AbC", "x" * 100, "é" * 11 + "z", "abcabcabc" * 9] + [(d.text or "")[:700] for d in docs.values()][:30]
    for t in texts:
        h, p = winnowing.winnow(winnowing.code_points(t))
        assert list(zip(h.tolist(), p.tolist())) == slow_winnow(t)


def test_op9(spark, sf_dir, docs):
    order = sorted(docs, reverse=True)
    for r in winnowing.compare_next(queries.table(spark, sf_dir, "documents"), parts=5).collect():
        text = docs[r.doc_id].text or ""
        after = docs[order[(order.index(r.doc_id) + 1) % len(order)]].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, following = ({h for h, _ in slow_winnow(t)} for t in (text, edited, after)) if len(text) < 900 else (None,) * 3
        if own is not None:
            assert r.near_edited == pytest.approx(len(own & changed) / len(own | changed))
            assert r.near_next == pytest.approx(len(own & following) / len(own | following))


# Classifiers


def test_op8_held_out(spark, docs, sf_dir):
    rows = [r for r in queries.op8_language(spark, sf_dir).collect() if r.held_out]
    assert all(crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in rows) / len(rows) > 0.93


def test_languages_of_copies_and_many_languages_are_learned(spark):
    """Copies and size don't change the sample: 100,000 rows of five texts teach as much as five rows."""
    texts = ["una casa vieja en la calle", "los perros duermen mucho", "el mar azul brilla hoy", "nadie sabe la hora", "cada tarde llueve"]
    rows = spark.range(100_000).select(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 5 + 1).cast("int")).alias("text"), F.lit("es").alias("lang"))
    few = spark.createDataFrame([(t, "es") for t in texts], "text string, lang string")
    learned = langid.learn(rows, F.lit(True))
    assert learned == langid.learn(few, F.lit(True)) and all(t.encode() in learned["es"] for t in texts)
    once = spark.range(3000).select(F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("xx").alias("lang"))
    heavy = once.unionByName(once.limit(1).crossJoin(spark.range(50_000)).select("text", "lang"))
    assert langid.learn(once, F.lit(True)) == langid.learn(heavy, F.lit(True))
    many = spark.range(250).select(F.concat(F.lit("a text of "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert len(langid.learn(many, F.lit(True))) == 250


def test_op10_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    rows = [r for r in queries.op10_toxicity(spark, folder).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good = [r.score for r in rows if labels[r.doc_id] == 0]
    bad = [r.score for r in rows if labels[r.doc_id] == 1]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.75 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_op1_finds_notices(spark, docs, sf_dir):
    for r in queries.op1_license_scan(spark, sf_dir).collect():
        lines = (docs[r.doc_id].text or "").split("\n")
        named = [x for x in lines if re.search("(?i)licensed under|released under|all rights reserved", x)]
        assert r.n_licenses == len(named)


def test_license_of_unknown_text():
    model = licenses.fit(["some plain words here", "nothing to see", "the rest of the page"] * 5)
    prob = model.probabilities(["Released under the MIT License.", "a walk in the park", ""], licenses.Words())
    assert licenses.FAMILIES[prob[0, 1:].argmax()] == "MIT" and prob[0].argmax() > 0
    assert prob[1].argmax() == 0 and not licenses.confirmed("a walk under the License", "MIT")


WRAPPED = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License",
}


def test_wrapped_license_headers(spark):
    """Headers over several lines, behind comment marks, and inside a long line, at their code points."""
    prose = "é😀 a walk in the park " * 60
    texts = []
    for family, header in WRAPPED.items():
        texts += [(family, header, f"{prose}\n\n{header}\n\nthe rest of the page\n")]
        marked = header.replace("\n", "\n * ")
        texts += [(family, marked, f"İ /*\n * {marked}\n */\nnext words\n")]
        flat = header.replace("\n", " ")
        texts += [(family, flat, prose + flat + " " + prose)]
    docs = spark.createDataFrame([(i, t[2]) for i, t in enumerate(texts)], "doc_id long, text string")
    model = licenses.fit(["some plain words here", "nothing to see", "the rest of the page", prose[:600]] * 20)
    for r in licenses.scan(docs, model).collect():
        family, want, text = texts[r.doc_id]
        assert [(x["family"], text[x["start"] : x["end"]].rstrip(').;/"')) for x in r.found] == [(family, want.rstrip(').;/"'))]
    blank = spark.createDataFrame([(0, "one\ntwo\n \nthree\n\n\nfour")], "doc_id long, text string")
    assert licenses.scan(blank, model).first().n_paragraphs == 3
    assert licenses.windows("Redistribution and use in source and binary\n\nforms with or without modification") == []


# Pipeline


def test_pipeline(spark, sf_dir, library):
    """Each stage against what it may change, on what its predecessor kept."""
    docs = queries.table(spark, sf_dir, "documents").cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language ID":
            assert all(after[i] == before[i] for i in after) and len(after) >= 0.95 * len(before)
        elif name == "line dedup":
            assert set(after) == set(before)
            assert all(set((after[i] or "").split("\n")) <= set((before[i] or "").split("\n")) | {""} for i in after)
        elif name == "SimHash near-dedup":
            want = slow_components({i: slow_fingerprint(t or "") for i, t in before.items()})
            assert set(after) == {i for i, c in want.items() if i == c}
        else:
            assert set(after) == set(before)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(library.encode(t or "")) for i, t in before.items()}
    docs.unpersist()
