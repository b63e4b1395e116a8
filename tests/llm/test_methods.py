"""Each method against a brute-force version, an exact round trip or held-out accuracy."""

import random
import re

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, minhash, pii, quality_classifier, quality_rules, secret_scan, toxicity, trigrams, vector

SF = "/root/testdata/sf0.001"
PATH = tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = bpe.read_ranks(f.read())
ORACLE = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120) | st.text("aeth ing\n.é漢-=", max_size=200))
def test_bpe_equals_the_library_and_round_trips(text):
    text = text.encode("utf-8", "replace").decode()
    enc, dec = bpe.coder(PATH, tokenizers.PATTERN)
    ids = np.frombuffer(enc.encode(text), "<u4").tolist()
    assert ids == ORACLE.encode_ordinary(text)
    assert dec.decode(ids) == text


def test_bpe_keeps_the_first_arcs_of_short_pieces_only(monkeypatch):
    words = [a + b + c for a in (" antion", " èreêou", "zqxv") for b in ("thandat", "ñarc", "erre") for c in ("inst", "leleê", "")]
    enc = bpe.Encoder(RANKS, tokenizers.PATTERN)
    got = [enc[w] for w in words]
    assert len(enc.fst.arcs) <= 3 * bpe.HEAD
    monkeypatch.setattr(bpe, "KEPT_PIECE", 0)  # every arc is kept
    whole = bpe.Encoder(RANKS, tokenizers.PATTERN)
    assert got == [whole[w] for w in words] and len(whole.fst.arcs) > 3 * bpe.HEAD


def test_bpe_takes_frequent_pieces_back(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 8)
    enc = bpe.Encoder(RANKS, tokenizers.PATTERN)
    runs = []
    run = enc.fst.run
    monkeypatch.setattr(enc.fst, "run", lambda piece: runs.append(piece) or run(piece))
    for k in range(20):
        assert enc[" often"] and enc[f" w{k}"] and len(enc) + len(enc.older) <= 8
    assert runs.count(b" often") == 1


def test_bpe_survives_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 64)
    monkeypatch.setattr(bpe, "ARCS", 64)
    enc = bpe.Encoder(RANKS, tokenizers.PATTERN)
    for text in ("ab" * 700, "the quick brown fox " * 50, "=-" * 400, "".join(random.Random(1).choices("abcdefgh", k=900))):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ORACLE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_machine(data):
    pending, out = b"", []
    for byte in data:
        pending, text = bpe.utf8_step(pending, byte)
        out.append(text)
    got = "".join(out) + "�" * bool(pending)
    assert got == data.decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB1é .-漢", max_size=40), max_size=6))
def test_vector_words_equal_the_regex(texts):
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in texts]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in low]
    w = vector.words(pa.array(texts, pa.string()))
    assert w.counts.tolist() == [len(x) for x in words]
    flat = [x for y in words for x in y]
    by = {}
    for x, h in zip(flat, w.hashes.tolist(), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(0)

    def slow(p, q):
        return sum(1 / sum(max(p.get(z, 0) / p[x], q.get(z, 0) / q[x]) for z in {*p, *q}) for x in {*p} & {*q})

    for _ in range(20):
        a, b = (np.sort(rng.choice(60, 25, replace=False).astype(np.uint64)) for _ in range(2))
        p, q = rng.integers(1, 5, 25), rng.integers(1, 5, 25)
        want = slow(dict(zip(a.tolist(), p / p.sum())), dict(zip(b.tolist(), q / q.sum())))
        assert minhash.probability_jaccard(a, p, b, q) == pytest.approx(want)
    a, b = np.arange(0, 300, dtype=np.uint64), np.arange(30, 330, dtype=np.uint64)
    w = np.ones(300, int)
    hashed = [vector.mix(x + np.uint64(7)) for x in (a, b)]
    sig = minhash.signatures(np.concatenate(hashed), np.concatenate((w, w)), np.repeat([0, 1], 300), 2)
    assert abs((sig[0] == sig[1]).mean() - 270 / 330) < 0.12


def test_near_duplicate_classes_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([6, 40, 120]))) for _ in range(25)]
    texts = list(base)
    for t in base:
        for _ in range(rng.randint(0, 6)):
            words = t.split()
            for _ in range(rng.choice([0, 1, 1, 2, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=50)) for _ in range(30)] + [texts[3].upper() + "!"] * 40 + ["", "one", "one"]
    w = vector.words(pa.array(texts))
    sets = minhash._sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if w.counts[i] and w.counts[j] and minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def brute_pii(t):
    def luhn(s):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m[0]))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def test_pii_base_spans_equal_brute_force(spark):
    import hashlib

    rng = random.Random(4)
    parts = ["a.b@c.de", "x_y@z", "_d@e.f", "1.2.3.4", "999.1.1.1", "4785380592391139", "4785 3805-9239 1139", "+1 (743) 555-3824", "+12", "é", " ", ".", "@", "-", "12", "漢", "\n", "0000001.2.3.255", "a@b.c_d@e.f"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)] + ["a." * 3000 + "@b" + ".c" * 3000, "1" * 5000, "1 " * 5000]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(brute_pii(texts[r["doc_id"]]).encode()).hexdigest(), texts[r["doc_id"]][:80]


def test_disclosing_terms_are_found_and_common_ones_left(spark):
    far = " filler" * 60
    docs = [(k, f"zarquon{far} call zarquon at bob@x.example.org today please") for k in range(4)] + [(k, "please call today for news number") for k in range(4, 60)]
    docs += [(60, "unique words near lone@x.example.net"), (61, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    r = {x["doc_id"]: x["spans"] for x in pii.report(df).collect()}
    # far off and near alike, and "filler" as well, which only those documents hold
    assert r[0].startswith("remove:0:7,remove:8:14") and "remove:433:440" in r[0] and r[0].endswith("email:444:461") and r[10] == ""
    assert r[60] == "email:18:36" and r[61] == r[None] == ""
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(df).collect()}
    assert clean[0].split() == "call at [EMAIL] today please".split() and clean[60] == "unique words near [EMAIL]"


def brute_disclosure(texts):
    """{(document, term): disclosure}, from counts over all documents."""
    spans = [[x.split(":") for x in brute_pii(t).split(",") if x] for t in texts]
    ent = [{(k, (re.sub("[^0-9]", "", t[int(a) : int(b)]) if k in ("card", "phone") else t[int(a) : int(b)].lower())) for k, a, b in sp} for t, sp in zip(texts, spans, strict=True)]
    word = [{w.lower() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}", t)} for t in texts]
    n, out = len(texts), {}
    for e in set().union(*ent):
        n_e = sum(e in x for x in ent)
        for t in set().union(*(w for w, x in zip(word, ent, strict=True) if e in x)):
            n_et = sum(e in x and t in w for x, w in zip(ent, word, strict=True))
            if n_et >= pii.MIN_SUPPORT and n_e < n:
                d = np.log2(n * n_et / (n_e * sum(t in w for w in word))) / np.log2(n / n_e)
                if d >= pii.GENERALISE_AT:
                    for k, x in enumerate(ent):
                        if e in x and t in word[k]:
                            out[k, t] = max(out.get((k, t), 0), d)
    return out


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(8)
    people = [f"p{k}@mail.example" for k in range(6)] + ["10.0.0.1", "+44 20 7946 0958"]
    names = [f"name{chr(97 + k)}" for k in range(12)]
    common = [f"word{chr(97 + k)}" for k in range(26)]
    texts = []
    for _ in range(260):
        who = rng.sample(range(8), rng.choice([0, 0, 1, 1, 2]))
        parts = rng.choices(common, k=15) + [people[w] for w in who] + [names[w] for w in who if rng.random() < 0.9] + [names[8 + w % 4] for w in who if rng.random() < 0.5]
        parts += [rng.choice(names)] * (rng.random() < 0.08)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    # an entity most of whose documents hold nothing else
    texts += ["solo@mail.example"] * 25 + ["solo@mail.example zarquon"] * 3 + ["zarquon"] * 3
    want = brute_disclosure(texts)
    assert any(d < pii.REMOVE_AT for d in want.values()) and any(d >= pii.REMOVE_AT for d in want.values())
    found = {}
    for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x):
            if kind in ("remove", "generalise"):
                found[r["doc_id"], texts[r["doc_id"]][int(a) : int(b)].lower()] = kind
    # terms that only stand inside a protected value have no place of their own
    apart = {(k, t): d for (k, t), d in want.items() if t in re.sub(r"\S+@\S+", " ", texts[k]).lower().split()}
    assert found == {k: "remove" if d >= pii.REMOVE_AT else "generalise" for k, d in apart.items()}


def test_many_matches_of_one_text(spark):
    t = "x token=abcdef " * 1500
    got = secret_scan.report(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert got["n_assign"] == 1500 and got["spans"].endswith(f"assign:{15 * 1499 + 2}:{15 * 1499 + 14}")
    red = secret_scan.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).select(secret_scan.redact(F.col("text"), F.col("spans"))).first()[0]
    assert red == "x [SECRET] " * 1500


def test_trigram_queries_are_necessary():
    samples = {"assign": ["API_KEY = abcdef", "my passwd:xyzxyz", 'toKen="abc.def"'], "access": ["AKIA" + "A" * 16], "pem": ["-----BEGIN RSA PRIVATE KEY-----"], "github": ["ghp_" + "a" * 36],
               "slack": ["xoxb-1234567890"], "jwt": ["eyJabcdefgh.abcdefgh.abcdefgh"], "bearer": ["Bearer " + "a" * 20]}
    for rule in secret_scan.RULES:
        q = trigrams.query(rule.pattern)
        for t in samples.get(rule.kind, []):
            assert re.search(rule.pattern, t)
            assert trigrams.holds(q, lambda g, t=t: g in t.lower()) is not False


def test_redaction(spark):
    d = spark.createDataFrame([(1, "é token = abcdef012345 é"), (2, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in secret_scan.scan(d).select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [SECRET] é", 2: "none"}


def test_decontamination_in_blocks_equals_one_block(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.report(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 300)
    assert sorted(map(tuple, decontamination.report(docs, bench).collect())) == want


def test_repeated_words_whatever_the_hash_tells_apart(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c x a b c y"), (2, "a a a a a"), (3, "a b c d"), (4, "a b c p q r a b c"), (5, ""), (6, "a b c")], "doc_id long, text string")
    want = {1: 6, 2: 5, 3: 0, 4: 6, 5: 0, 6: 0}
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measures(d).collect()} == want
    # with one bit of hash left nearly all windows agree in it, in any order
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 63)
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measures(d).collect()} == want


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=600) * 0.3, [0.5, 1.5, 2.5])
    w, theta = toxicity.fit_ordinal(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < 1 and (np.diff(theta) > 0).all()


def test_toxicity_held_out(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    bad = ["vile", "nasty", "awful"]
    docs, labels = [], []
    for k in range(600):
        ws, toxic = [word() for _ in range(60)], k % 4 == 0
        if toxic:
            ws[rng.randrange(60)], ws[rng.randrange(60)] = rng.choice(bad), rng.choice(bad)
        docs.append((k, " ".join(ws)))
        labels += [(k, int(toxic))] if k < 400 else []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.report(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = range(400, 600)
    assert sum(got[k]["rejected"] == (k % 4 == 0) for k in held) >= 190
    assert not any(got[k]["rejected"] for k in held if k % 4)


def test_resampling_prefers_target_and_counts_exactly(spark):
    good = [(k, "the cat sat on the mat with a hat " * 3) for k in range(40)]
    junk = [(k, "zz qq xx vv zz kk " * 3 + str(k)) for k in range(40, 60)]
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    out = quality_classifier.resample(spark.createDataFrame(good + junk, "doc_id long, text string"), labels, fraction=0.5).collect()
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert len(kept) == 30 and all(k < 40 for k in kept)
    df = spark.range(9000).select((F.xxhash64("id") % 1000).cast("double").alias("v"))
    ranked = sorted((r["v"] for r in df.collect()), reverse=True)
    for k in (1, 4500, 9000):
        assert quality_classifier.kth_largest(df, "v", k) == ranked[k - 1]


def test_templates_from_a_table_match_like_a_plain_search(spark):
    from lectern.llm import license_scan

    table = spark.createDataFrame([("own", "You may NOT use, copy or sell x without leave", 0, 4), ("two", "sell x", None, None), ("none", "...", None, None)], "label string, text string, key_first int, key_words int")
    templates = license_scan.templates_of(table)
    assert [(t.label, t.key_words) for t in templates] == [("own", ["you", "may", "not", "use"]), ("two", ["sell", "x"])]
    rng = random.Random(6)
    words = "you may not use copy or sell x without leave and".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", " you may not use copy or sell x"]) for _ in range(120)]
    got = {r["doc_id"]: sorted((h["label"], h["start"], round(h["support"], 6)) for h in r["hits"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    for k, t in enumerate(texts):
        w, want = t.split(), []
        for tpl in templates:
            first, n = tpl.key_span
            for p in range(len(w) - n + 1):
                if w[p : p + n] == tpl.key_words:
                    agree = sum(0 <= p - first + i < len(w) and w[p - first + i] == x for i, x in enumerate(tpl.words)) / len(tpl.words)
                    want += [(tpl.label, p, round(agree, 6))] if agree >= license_scan.MIN_SUPPORT else []
        assert got[k] == sorted(want)
