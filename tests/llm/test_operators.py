"""Registered queries against their SQL, brute force, round trips or held-out accuracy."""

import random
import re

import numpy as np
import pytest
from conftest import SF, same_rows

import corpus_pipeline
from trivane.llm import licenses, mixing, pii, toxicity, warc
from trivane.llm.components import components
from trivane.llm.decontaminate import contamination
from trivane.llm.jaccard import jaccard_groups, links_of
from trivane.llm.queries import ORACLES, QUERIES
from trivane.llm.substrings import NULL_ID, lengths, remove_repeats


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = same_rows(QUERIES[name](spark, SF), duck.execute(ORACLES[name]))
    assert a == b


def test_all_ten_are_registered():
    assert {re.match(r"op(\d+)_|", n)[1] for n in QUERIES} - {None} == {str(k) for k in range(1, 11)} and "pipeline" in QUERIES


def test_vectors_against_brute_force(spark):
    """Planted groups: copies, near copies, one large group; every link above the threshold is found."""
    from trivane.llm.embeddings import near_vectors

    r = np.random.default_rng(1)
    base = r.normal(size=(300, 32))
    x = np.concatenate([base, base[:40], base[:60] + r.normal(size=(60, 32)) * 0.2, base[0] + r.normal(size=(500, 32)) * 0.25]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {q.vec_id: q for q in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(q.n_links for q in got.values())
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x))) and found >= 0.9 * link.sum()
    assert all(q.kept == (q.vec_id == q.component_id) for q in got.values())


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_groups(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 50), (5, 80), (1, 100)])
def test_jaccard_against_brute_force(spark, n, percent, monkeypatch):
    import trivane.llm.jaccard as j

    monkeypatch.setattr(j, "LIST", 6)  # so that block joins are used on small data too
    monkeypatch.setattr(j, "BLOCK", 8)
    r = random.Random(n)
    pool = [[r.choice("abcdefghijklmnop") + r.choice("abcdefgh") for _ in range(r.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(160):
        w = list(r.choice(pool))
        for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice("QRSTUV")
        rows.append((i, " ".join(w[: r.choice([3, 60, 60])])))
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_groups(rows, n, percent)


def test_divide_skip_finds_all_links():
    r = np.random.default_rng(3)
    sets = [np.unique(r.choice(60, r.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    sets += [s[r.random(len(s)) > 0.1] for s in sets[:40]]
    for percent in (50, 85):
        root = list(range(len(sets)))
        for a, b in links_of(sets, percent):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            root = [root[b] if x == root[a] else x for x in root] if root[a] != root[b] else root
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    assert root[a] == root[b]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(k, 100) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}


@pytest.mark.parametrize("window", [13, 3, 30])
def test_repeats_against_brute_force(spark, window):
    r = random.Random(window)
    pool = [[r.choice("abcdefgh") for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(80):
        t = []
        for _ in range(r.randint(0, 4)):
            p, a = r.choice(pool), r.randint(0, 40)
            t += p[a : a + r.randint(1, 60)] + [r.choice("xyzuvw") for _ in range(r.randint(0, 5))]
        rows.append((i if r.random() > 0.05 else None, " ".join(t) if r.random() > 0.05 else None))
    rows += rows[:5] + [(3, "other text")]
    assert lengths(window)[-1] == window
    first = {}
    key = lambda d: NULL_ID if d is None else d
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, NULL_ID), key(d))
    want = []
    for d, t in rows:
        w, gone = (t or "").split(), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone |= set(range(i, i + window))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), window).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in got), key=repr) == sorted(want, key=repr)


def test_containment_of_short_items_in_long_texts(spark):
    r = random.Random(2)
    item = ["w%d" % k for k in range(14)]  # ten shingles: eight must be there
    texts = []
    for i in range(40):
        w = [r.choice("abcdef") + str(r.randrange(5000)) for _ in range(4000)]
        cut = item[: r.randint(9, 14)]
        w[i * 50 : i * 50] = cut
        texts.append((i, " ".join(w).upper(), len(cut) >= 12))
    got = {x.doc_id for x in contamination(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {i for i, _, bad in texts if bad}


def test_licenses_against_brute_force(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "GNU GENERAL PUBLIC LICENSE v3; mit-license MIT License\n(c)", "cc by nc 4.0 and CC-BY", "gnu general public licence", "SPDX-License-Identifier: MPL-2.0", "commit licenses", "mit license mit license", "ünïmit license"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places})) and set(got[i].base_labels.split(",")) - {""} <= set(got[i].labels.split(","))
    assert "apache-2.0" in got[0].labels and "gpl-3.0" in got[1].labels and "cc-by-nc" in got[2].labels and got[3].labels == "gpl" and got[4].labels == "mpl" or "mpl-2.0" in got[4].labels
    # The wrapped form of higher priority suppresses the bare name inside it.
    assert [(d.label, d.priority) for d in got[0].detections] == [("apache-2.0", 2)]
    assert len(licenses.rules()) >= 200 and len({r[3] for r in licenses.rules()}) == len(licenses.rules())


def test_licenses_of_identifiers_joined_versions_and_texts(spark):
    texts = [
        ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
        ("under GPLv2", "gpl-2.0"), ("released under the GPLv3 or later", "gpl-3.0-or-later"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd"),
        ("You may not use this file except in compliance with the License.", "apache"), ("we commit to a mitigation", ""),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).select("doc_id", "labels").collect()
    assert {r.doc_id: r.labels for r in got} == {i: x for i, (_, x) in enumerate(texts)}
    assert len({r[3] for r in licenses.rules()}) == len(licenses.rules()) and len(licenses.NAMES) + len(licenses.SPDX) + len(licenses.BODIES) >= 300


def test_mixing_meets_targets(spark):
    rows = QUERIES["op7_mix_sources"](spark, SF).collect()
    src = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    by = {}
    for r in rows:
        s = by.setdefault(src[r.doc_id], [0, 0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[1] += r["size"]
        s[4] = max(s[4], r["size"])
    total = sum(s[1] for s in by.values())
    assert all(s[1] == s[3] and s[2] <= 3 * s[1] + 1e-6 for s in by.values()) and sum(s[2] for s in by.values()) == pytest.approx(total)
    # Water filling by hand.
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(by))}
    open_, want, left = set(by), {}, float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * by[s][1]}
        if not full:
            want.update(share)
            break
        for s in full:
            want[s] = 3.0 * by[s][1]
            left -= want[s]
        open_ -= full
    assert all(by[s][2] == pytest.approx(want[s]) for s in by)
    assert all(abs(s[0] - s[2]) <= s[4] for s in by.values()) and all(r.taken <= 3 * r["size"] for r in rows)


def test_balance_solves_closely(spark):
    rng = np.random.default_rng(4)
    hist = [(f"s{k}", int(s), int(n)) for k in range(60) for s, n in zip(rng.choice(np.arange(1, 3000), 30, replace=False), rng.integers(1, 50, 30), strict=True)]
    total = {k: sum(s * n for g, s, n in hist if g == k) for k, _, _ in hist}
    targets = [(k, v, v * float(rng.uniform(0.2, 2.5))) for k, v in total.items()]
    lam = {r.source: r for r in mixing.balance(spark.createDataFrame(hist, "source string, size long, n long"), spark.createDataFrame(targets, "source string, source_size long, target double")).collect()}
    for k, _, target in targets:
        words = sum(s * n * min(3.0, float(np.exp(min(50.0, lam[k].lam * s / lam[k].mean)))) for g, s, n in hist if g == k)
        assert abs(words - target) <= 2e-7 * target


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 1000):
        f = pii.Feistel(b"k", "t", size)
        assert sorted(map(f.permute, range(size))) == list(range(size)) and all(f.invert(f.permute(x)) == x for x in range(size))


def test_pseudonyms_keep_format_and_link():
    p, q = pii.Pseudonyms(b"one"), pii.Pseudonyms(b"two")
    values = {"card": "4041894974608795", "phone": "+1 (988) 555-2485", "ip": "70.123.182.155", "email": "bosbt.42", "ssn": "123-45-6789", "iban": "DE89370400440532013000", "date": "1980-02-29", "secret": "b7db7aa4a5fcc78305", "access_key": "SJDZWJNP6ZRYWK44", "phone_abroad": "+44 20 7946 0958"}
    for kind, v in values.items():
        new = p.value(kind, v)
        assert new == p.value(kind, v) != v and q.value(kind, v) != new
        assert re.sub(r"[0-9a-f]" if kind == "secret" else r"\d", "9", new) == re.sub(r"[0-9a-f]" if kind == "secret" else r"\d", "9", v) or kind in ("ip", "email", "access_key")
    assert pii.luhn_digit(p.value("card", values["card"])[:-1]) == int(p.value("card", values["card"])[-1]) and pii.iban_valid(p.value("iban", values["iban"]))
    one, _ = p.rewrite("call +1 (988) 555-2485")
    two, _ = p.rewrite("or 988.555.2485 now")
    assert re.sub(r"\D", "", one)[-10:] == re.sub(r"\D", "", two)
    text = "no 4041894974608796, 30.02.1980, 300.1.1.1, 10.0.0.1 or 000-12-3456 here"
    assert p.rewrite(text) == (text, [])
    assert p.value("date", "29.02.1980") == ".".join(reversed(p.value("date", "1980-02-29").split("-")))


@pytest.mark.parametrize("unit", ["aB3-", "0f3a", "Zz9._/+q"])
def test_secrets_are_replaced_to_their_end(unit):
    p, secret = pii.Pseudonyms(b"one"), unit * 101
    text, spans = p.rewrite(f"token={secret} end")
    new = text.removeprefix("token=").removesuffix(" end")
    assert spans == [("secret", 6, 6 + len(secret))] and len(new) == len(secret)
    assert sum(a == b for a, b in zip(new[250:], secret[250:], strict=True) if b.isalnum()) < len(secret[250:]) / 3
    other = p.value("secret", secret[:-1] + ("1" if secret[-1].isdigit() else "b" if secret[-1].isalpha() else "-"))
    assert p.value("secret", secret) == new and (secret[-1] == "-" or sum(a == b for a, b in zip(other, new, strict=True)) < len(new) * 0.6)
    assert all(x.isdigit() == y.isdigit() and x.isupper() == y.isupper() for x, y in zip(new, secret, strict=True)) or unit == "0f3a"


def test_secrets_of_json_keys():
    p = pii.Pseudonyms(b"one")
    for text in ('{"password": "hunter2hunter2"}', "{'api_key':'hunter2hunter2'}", 'TOKEN" = hunter2hunter2'):
        assert "hunter2" not in p.rewrite(text)[0] and len(p.rewrite(text)[0]) == len(text)


def test_dates_and_ibans_in_common_layouts():
    p = pii.Pseudonyms(b"one")
    day = p.value("date", "1999-12-25")
    y, m, d = day.split("-")
    for text, new in (("1999-12-25T10:11:12Z", f"{day}T10:11:12Z"), ("1999-12-25t10", f"{day}t10"), ("1999/12/25", f"{y}/{m}/{d}"), ("25/12/1999", f"{d}/{m}/{y}"), ("12/25/1999", f"{m}/{d}/{y}"), ("25.12.1999", f"{d}.{m}.{y}")):
        assert p.rewrite(f"on {text} then")[0] == f"on {new} then"
    assert all(p.rewrite(x)[0] == x for x in ("2021/13/45", "30/02/1999", "31/31/1999", "a/2021/03/04/b", "1999-12-25Tx"))
    days = [f"{a}/{b}/1999" for a in range(1, 32) for b in range(1, 13) if b < 12 or a < 31] + [f"{b}/{a}/1999" for a in range(13, 32) for b in range(1, 13)]
    news = {x: p.value("date", x) for x in days}
    assert len({y for y in news.values() if y}) == sum(1 for y in news.values() if y)
    assert all((int(x.split("/")[0]) > 12) == (int(y.split("/")[0]) > 12) for x, y in news.items() if y)
    for iban in ("DE89 3704 0044 0532 0130 00", "ES91 2100 0418 4502 0005 1332", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "BE68 5390 0754 7034"):
        new, plain = p.value("iban", iban), p.value("iban", iban.replace(" ", ""))
        assert new.replace(" ", "") == plain != iban.replace(" ", "") and [c == " " for c in new] == [c == " " for c in iban]
        for after in ("", ".", " BANK", " EUR 5", " AB", " CODE WORD 1234"):
            assert p.rewrite(f"to {iban}{after}")[0] == f"to {new}{after}"


def test_bundles_are_seekable(tmp_path):
    import zstandard

    path = str(tmp_path / "b.warc.zst")
    w = warc.BundleWriter(path)
    bodies = [b"%d" % i * 3000 for i in range(400)]
    for i, b in enumerate(bodies):
        w.add(warc.record_id(i), i, warc.record(i, f"http://h/{i}", b, len(b), "d", None))
    index = w.close()
    table = warc.seek_table(path)
    data = open(path, "rb").read()
    assert len(table) > 3 and sorted({r[3] for r in index}) == list(range(len(table)))
    for _, pid, _, frame, offset, length in (index[0], index[177], index[-1]):
        at, size, _ = table[frame]
        plain = zstandard.ZstdDecompressor().decompress(data[at : at + size])
        assert len(plain) == table[frame][2] and warc.parse_record(plain[offset : offset + length])["payload"] == bodies[pid]
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 400


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.8), ("op6_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    p, n = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    assert auc >= least and np.mean([b >= 0.7 for b in n]) <= 0.1


def test_pairs_of_neutral_words_are_learned():
    """Insult and group each occur as often in clean as in toxic documents; toxic is what has both."""
    rng = np.random.default_rng(2)
    sets, y = [], []
    for k in range(3000):
        words = rng.choice(np.arange(100, 4000), 40, replace=False)
        both = k % 10 == 0
        mark = [7, 11] if both else [[7], [11], []][int(rng.integers(3))]
        sets.append(np.unique(np.concatenate([words, mark])).astype(np.int32))
        y.append(int(both))
    for _ in range(600):  # toxic by none of the words, so that each of the two is neutral alone
        sets.append(np.unique(rng.choice(np.arange(100, 4000), 40, replace=False)).astype(np.int32))
        y.append(1)
    y = np.array(y)
    for w in (7, 11):
        has = np.array([w in s for s in sets])
        assert toxicity.chi_squared(has.sum(), y[has].sum(), len(y), int(y.sum())) < toxicity.LEAST_CHI2
    model = toxicity.fit(sets, y)
    assert {7, 11} <= set(model.slots.tolist())
    pad = np.arange(100, 140)
    tests = [np.concatenate([m, pad]).astype(np.int32) for m in ([7, 11], [7], [11])]
    z = model.logits(*model.kept_of(tests), 3)
    assert z[0] > z[1:].max() + 2


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of its rule, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        out[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == before.columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    before, after = out["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {i for i, _, c in brute_groups(rows, 5, 80) if i == c}
    before, after = out["benchmark decontamination"]
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}
    items = [grams(alnum(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = lambda t: any(len(g & s) >= 0.8 * len(g) - 1e-9 for g in items for s in [grams(alnum(t))])
    assert ids(after) == {r.doc_id for r in before.collect() if not hit(r.text)}
    before, after = out["PII"]
    p = pii.Pseudonyms()
    assert {(r.doc_id, p.rewrite(r.text)[0]) for r in before.collect()} == {(r.doc_id, r.text) for r in after.collect()}
    before, after = out["toxicity"]
    assert 0.02 < 1 - after.count() / before.count() < 0.3
    assert ids(out["mixing sources"][1]) <= ids(out["PII"][1])


def test_license_detections_against_brute_force(spark, monkeypatch):
    """Matches, suppression, labels and score by plain Python; runs of few items, so that walks cross their borders."""
    monkeypatch.setattr(licenses, "RUN", 3)
    r = random.Random(8)
    vocabulary = sorted({w for _, label, key, pattern, _ in licenses.rules() for w in [key, *re.findall(r"[a-z0-9]+", label)]} | {"the", "license", "version", "under", "or", "later", "only", "public", "2", "3", "0"})
    names = ["gnu general public license version 2 or later", "apache license", "cc by", "mit license", "spdx license identifier mit", "licensed under the apache license version 2 0", "gpl v3", "permission is hereby granted"]
    rows = [(i, " ".join(r.choice(names) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(r.choice([0, 3, 40, 150])))) for i in range(60)]
    rows.append((60, "mit license " * 2000))
    table = [(rank, label, key, re.compile(pattern), p) for rank, label, key, pattern, p in licenses.rules()]
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        norm = f" {text.strip()} "
        words = set(norm.split())
        found = []
        for rank, label, key, pattern, p in table:
            if key in words:
                for m in pattern.finditer(norm):
                    first = norm.count(" ", 0, m.start()) - 1
                    found.append((first, -(first + m[0].count(" ")), -p, rank, label))
        left = []
        for first, last, p, _, label in sorted(found):
            if not any(a <= first and -last <= b and q >= -p for _, a, b, q in left):
                left.append((label, first, -last, -p))
        assert [tuple(x) for x in got[i].detections] == left, text
        own = {label for phrase, label in licenses.BASE if f" {phrase} " in norm}
        assert got[i].labels == ",".join(sorted({x[0] for x in left} | own))
        score = 1.0
        for _, p in {(x[0], x[3]) for x in left}:
            score *= 1 - 0.25 * p
        assert abs(got[i].score - (1 - score)) < 1e-9


def test_scores_against_plain_formulas():
    """The machine's scores pair by pair, the discriminant's by densities."""
    from trivane.llm import quality

    r = np.random.default_rng(4)
    m = toxicity.FactorizationMachine(np.arange(0, 40, 2), 0.3, r.normal(size=20), r.normal(size=(20, 8)))
    sets = [np.unique(r.choice(45, 12)).astype(np.int32) for _ in range(30)] + [np.zeros(0, np.int32)]
    z = m.logits(*m.kept_of(sets), len(sets))
    for s, got in zip(sets, z, strict=True):
        at = [int(x) // 2 for x in s if x % 2 == 0 and x < 40]
        want = 0.3 + sum(m.w[i] for i in at) + sum(m.v[i] @ m.v[j] for k, i in enumerate(at) for j in at[:k])
        assert abs(got - want) < 1e-9
    x = np.concatenate([r.normal(size=(200, 5)), r.normal(size=(150, 5)) * [1, 2, 1, 3, 1] + 1])
    y = np.repeat([0, 1], [200, 150])
    model = quality.fit(x, y)
    c = np.clip((x - x.mean(0)) / x.std(0), -quality.REACH, quality.REACH)
    logs = []
    own = [np.cov(c[y == k].T, bias=True) for k in (0, 1)]
    pooled = (own[0] * 200 + own[1] * 150) / 350
    for k, n in ((0, 200), (1, 150)):
        s = (1 - quality.TOWARDS_POOLED) * own[k] + quality.TOWARDS_POOLED * pooled
        s = (1 - quality.TOWARDS_DIAGONAL) * s + quality.TOWARDS_DIAGONAL * np.diag(np.diag(s)) + quality.RIDGE * np.eye(5)
        d = c - c[y == k].mean(0)
        logs.append(np.log(n / 350) - np.linalg.slogdet(s)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) / 2)
    assert np.abs(model.difference(x) - (logs[1] - logs[0])).max() < 1e-8


def test_mixture_against_plain_rates(spark):
    """Targets, entropy-balanced rates by bisection, and copies that round them."""
    r = random.Random(5)
    rows = [(i, "abcd"[min(i % 5, 3)], " ".join("w" * r.choice([0, 1, 3, 10, 40, 200]))) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {}
    for x in got:
        by.setdefault(x.source, []).append(x)
    total = sum(x["size"] for x in got)
    open_, left, target = sorted(by), total, {}
    while open_:  # share by weight; what is above three times its source goes round again
        share = {s: left * (1, 2, 3)[sorted(by).index(s) % 3] / sum((1, 2, 3)[sorted(by).index(q) % 3] for q in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * by[s][0].source_size]
        for s in over or open_:
            target[s] = 3 * by[s][0].source_size if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    for s, docs in by.items():
        sizes = np.array([x["size"] for x in docs], float)
        assert abs(docs[0].target - target[s]) < 1e-6 * target[s]
        mean, lo, hi = sizes.mean(), -1e3, 1e3
        rate = lambda lam: np.minimum(3, np.exp(np.minimum(lam * sizes / mean, 50)))  # noqa: E731, B023
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if (rate(lam) * sizes).sum() < target[s] else (lo, lam)
        some = sizes > 0
        if target[s] < 3 * sizes.sum():
            assert np.abs(np.array([x.rate for x in docs])[some] - rate(lam)[some]).max() < 1e-4
        assert all(x.copies in (int(x.rate), int(x.rate) + 1) and x.copies <= 3 and x.taken == x.copies * x["size"] for x in docs)
        assert abs(sum(x.taken for x in docs) - target[s]) <= 200


def test_pseudonyms_of_many_values_and_tokens():
    p = pii.Pseudonyms(b"one")
    text = "on 2021-03-04 and " * 5000
    new, spans = p.rewrite(text)
    assert len(spans) == 5000 and new == f"on {p.value('date', '2021-03-04')} and " * 5000
    for token in ("ghp_0123456789abcdefABCDEF0123456789abcd", "glpat-ABCDEFGHIJKLMNOPQRST", "xoxb-123456789012-abcdefABCDEF"):
        assert token[6:] not in p.rewrite(f"use {token} here")[0]
    local = "a1" * 60
    assert local not in p.rewrite(f"{local}@example.org")[0]
    # Overlaps by brute force: earlier kinds win, spans never overlap.
    mixed = "token=2021-03-04x5 4111-1111-1111-1111 10.1.2.3 a@b.c 8.8.8.8 " * 50
    spans = p.rewrite(mixed)[1]
    taken = set()
    for _, a, b in spans:
        assert not taken & set(range(a, b))
        taken |= set(range(a, b))
