"""Secrets, packing, near duplicates, leaks, language and toxicity against plain versions."""

import base64
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from triskel.llm import decontaminate, langid, minhash, packing, secrets, toxicity
from triskel.llm.text import LONG_RUN, mix, run_hashes, shingles, words

SF = "/root/testdata/sf0.001"
TOKENIZER = entry_point.queries()["op6_packed_windows"].__globals__["_tokenizer"]()
LONG = "lorem ipsum dolor " * 40_000
DOCS = "doc_id bigint, text string, id bigint, leaks string, size int"


def docs(spark, rows):
    """Documents with other columns whose names an operator also uses."""
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- secrets

JWT = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1234567890"})) + ".c2lnbmF0dXJl"


def der(tag, body):
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else b"\x82" + size.to_bytes(2, "big")) + body


RSA = der(0x30, b"".join(der(0x02, bytes([n % 120 + 1]) * k) for n, k in zip(range(9), (1, 64, 3, 64, 32, 32, 32, 32, 32))))
RSA = der(0x30, der(0x02, b"\x00") + b"".join(der(0x02, b"\x11" * k) for k in (64, 3, 64, 32, 32, 32, 32, 32)))


def plain_base(text):
    kinds = [
        ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
        ("hex", r"[0-9a-f]+", 0, 0, 24),
    ]
    out = []
    for rank, (kind, pattern, flags, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text, flags):
            if len(m[group]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_findings_equal_the_plain_patterns():
    rnd = random.Random(3)
    parts = ["password", "PassWd: ", "api_key='", "apikey =", "AKIA", "ABCD1234" * 3, "deadbeef" * 4, "é", " ", "token==", "x" * 7, "secret", ":", "=", '"', "abc"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(12))
        assert ",".join(f"{k}:{s}:{e}" for s, e, k in secrets._sorted(secrets.base_findings(text))) == plain_base(text)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"x {JWT} y", "signed_token"),
        (f"k {base64.b64encode(RSA).decode()} y", "private_key"),
        (f"k {RSA.hex()} y", "private_key"),
        ("-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----", "private_key"),
    ],
)
def test_structures_are_confirmed(text, kind):
    assert kind in {k for _, _, k in secrets.findings(text)}


@pytest.mark.parametrize("text", [f"x {JWT[1:]} y", f"k {base64.b64encode(RSA[:-3]).decode()} y", "a" * 500, "AAAA" * 40, "1.2.3", "eyJhIjoxfQeyJhIjoxfQ.aaaa.bb"])
def test_what_does_not_parse_is_not_a_key(text):
    assert not [f for f in secrets.findings(text) if f[2] in ("private_key", "public_key", "signed_token")]


def pem(label, body, headers=""):
    return f"-----BEGIN {label}-----\n{headers}{base64.encodebytes(body).decode()}-----END {label}-----"


PBES2 = der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b"")) + der(0x04, b"\x5a" * 80))
PEM_FORMS = {
    "aes_headers": pem("RSA PRIVATE KEY", b"\x9d" * 96, "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,3F17F5316E2BAC89\n\n"),
    "indented_headers": pem("EC PRIVATE KEY", b"\x9d" * 48, "Proc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,3F17F5316E2BAC89\n\n").replace("\n", "\r\n    "),
    "encrypted_pkcs8": pem("ENCRYPTED PRIVATE KEY", PBES2),
    "json": json.dumps({"private_key": pem("RSA PRIVATE KEY", RSA) + "\n"}),
    "json_in_json": json.dumps(json.dumps({"private_key": pem("RSA PRIVATE KEY", RSA)})),
    "json_slashes": json.dumps({"private_key": pem("ENCRYPTED PRIVATE KEY", PBES2.replace(b"\x5a", b"\xff"))}).replace("/", "\\/"),
    "json_crlf_headers": json.dumps(pem("RSA PRIVATE KEY", b"\x9d" * 96, "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,3F17\n\n").replace("\n", "\r\n")),
}


@pytest.mark.parametrize("form", sorted(PEM_FORMS))
def test_every_form_of_a_pem_key_is_found_whole(form):
    text = f"a -----BEGIN X KEY----- b {PEM_FORMS[form]} c"
    start, end = text.index("-----BEGIN", 5), text.rindex("KEY-----") + len("KEY-----")
    found = secrets.findings(text)
    assert (start, end, "private_key") in found
    assert secrets._masked(text, found).count(secrets.MASK) == 1


def test_a_digest_or_unmatched_begin_is_no_key():
    sha1 = der(0x30, der(0x30, der(0x06, bytes.fromhex("2b0e03021a")) + der(0x05, b"")) + der(0x04, b"\x5a" * 20))
    assert not secrets.confirmed_findings(pem("ENCRYPTED PRIVATE KEY", sha1))
    assert not secrets.confirmed_findings("-----BEGIN RSA PRIVATE KEY-----\n" * 20_000 + "-" * 100_000)


def test_scan_and_mask(spark):
    df = docs(spark, [(1, "password=hunter22 " + LONG + "é" + "ab12" * 8), (2, None), (3, ""), (4, "token: abcdefg"), (4, "token: abcdefg")])
    got = sorted((r["doc_id"], tuple((f["kind"], f["start"], f["end"]) for f in r["findings"])) for r in secrets.scan_secrets(df, "doc_id", "text").collect())
    start = 18 + len(LONG) + 1
    assert got == [(1, (("assign", 0, 17), ("hex", start, start + 32))), (2, ()), (3, ()), (4, (("assign", 0, 14),)), (4, (("assign", 0, 14),))]
    masked = secrets.mask_secrets(df, "text")
    assert masked.columns == df.columns
    assert {r["text"] for r in masked.where("doc_id IN (2, 3, 4)").collect()} == {None, "", secrets.MASK}
    assert secrets.scan_secrets(df.limit(0), "doc_id", "text").count() == 0


def test_query_counts_agree_with_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    for r in entry_point.queries()["op7_secret_scan"](spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(plain_base(texts[r["doc_id"]] or "").encode()).hexdigest()


# ---------------------------------------------------------------- packing


def test_word_tokenizer_equals_the_tokenizer():
    w = packing.WordTokenizer(TOKENIZER)
    rnd = random.Random(1)
    odd = ["", "it's o'the 'solo ''s -'s I'LL don'T", "ΑΣ ΟΔΟΣ", "<|endoftext|> a", "١٢٣ ½", "naïve \x1c\x00\x85b", "日本語 👍🏽 zw‍j", "a" * 3000, "'", "' s", "İ ǅ ß"]
    odd += ["".join(rnd.choice("ab 'stmdrevl.,-1é\n ñ") for _ in range(80)) for _ in range(200)]
    for text, ids in zip(odd, w.encode(odd), strict=True):
        assert ids.tolist() == w.whole.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize(("sizes", "k"), [([], 3), ([5], 1), ([8, 7, 6, 5, 4], 2), ([1] * 10, 4), ([3, 3, 3, 9], 3), ([7, 7], 5)])
def test_karmarkar_karp_keeps_every_item(sizes, k):
    parts = packing.karmarkar_karp(sizes, k)
    assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))


def test_karmarkar_karp_differences_well():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.karmarkar_karp([8, 7, 6, 5, 4], 2)) == [14, 16]
    rnd = random.Random(0)
    sizes = [rnd.randint(1, 1000) for _ in range(600)]
    sums = [sum(sizes[i] for i in p) for p in packing.karmarkar_karp(sizes, 16)]
    assert max(sums) - min(sums) < 40


def test_windows_rise_when_capacity_is_exceeded():
    parts = packing.pack_group([6, 6, 6], 10)
    assert len(parts) == 3 and all(len(p) == 1 for p in parts)


def test_pieces_cover_every_id_once(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gammadelta", "7", "!"]) for _ in range(rnd.choice([1, 30, 900, 6000])))) for i in range(60)] + [(100, None), (101, ""), (102, LONG)]
    df = docs(spark, rows)
    tokens = {i: packing.WordTokenizer(TOKENIZER).encode([t or ""])[0].tolist() + [2] for i, t in rows}
    got = packing.pack_documents(df, "doc_id", "text", TOKENIZER).withColumn("crc", F.crc32("ids")).collect()
    whole, windows = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(whole.setdefault(r["doc_id"], [])) and len(ids) == r["length"] > 0 and r["crc"] == zlib.crc32(r["ids"])
        assert r["doc_tokens"] == len(tokens[r["doc_id"]])
        whole[r["doc_id"]] += ids
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert whole == tokens
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(df.limit(0), "doc_id", "text", TOKENIZER).count() == 0


# ---------------------------------------------------------------- near duplicates


def plain_classes(rows):
    """Exact components of shingle multisets, all pairs."""
    sets = []
    for _, t in rows:
        keys, owner = shingles(*words([t or ""]), 5)
        sets.append(dict(zip(*np.unique(keys, return_counts=True), strict=True)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = sum(min(c, sets[j].get(k, 0)) for k, c in sets[i].items())
            either = sum(sets[i].values()) + sum(sets[j].values()) - common
            if (rows[i][1] or "") == (rows[j][1] or "") or (either and common >= 0.8 * either):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (x, _) in enumerate(rows):
        least[find(i)] = min(x, least.get(find(i), x))
    return {x: least[find(i)] for i, (x, _) in enumerate(rows)}


def chained_texts(n, seed=0):
    """Texts of one family, each a few words from another: a class that no single text spans."""
    rnd = random.Random(seed)
    texts = [[f"w{rnd.randint(0, 10**6)}" for _ in range(120)]]
    while len(texts) < n:
        t = list(rnd.choice(texts[-6:]))
        for _ in range(rnd.choice([0, 1, 2])):
            t[rnd.randrange(len(t))] = f"w{rnd.randint(0, 10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(2)
    rows = list(enumerate(chained_texts(90) + [" ".join(f"u{rnd.randint(0, 500)}" for _ in range(60)) for _ in range(40)]))
    rows += [(500, None), (501, ""), (502, "!!!"), (503, "!!!"), (504, "two words"), (505, "Two  words!"), (506, LONG), (507, LONG + "end"), (508, "same " * 50), (509, "same " * 80)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, rows), "doc_id", "text").collect()}
    assert got == plain_classes(rows)


def test_near_duplicates_in_any_layout_and_with_repeats(spark):
    rows = list(enumerate(chained_texts(30, 4)))
    df = docs(spark, rows + rows[:5])
    one = sorted(tuple(r) for r in minhash.near_duplicates(df, "doc_id", "text").collect())
    two = sorted(tuple(r) for r in minhash.near_duplicates(df.repartition(7), "doc_id", "text").collect())
    assert one == two and len(one) == 35
    assert minhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    agree, true = [], []
    for _ in range(40):
        keys = rng.integers(1, 2**63, 200).astype(np.uint64)
        keys.sort()
        a = rng.geometric(0.3, 200)
        b = np.maximum(0, a + rng.integers(-3, 4, 200))
        signed = [minhash.bag_minhash(keys[w > 0], w[w > 0], np.zeros((w > 0).sum(), int), 1, 256)[0] for w in (a, b)]
        agree.append((signed[0] == signed[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert minhash.overlap((keys, a), (keys[b > 0], b[b > 0])) == pytest.approx(true[-1])
    assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.01)


# ---------------------------------------------------------------- benchmark leaks


def test_lcs_equals_the_table():
    rnd = random.Random(0)
    for _ in range(100):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(np.array(a), np.array(b)) == table[-1][-1]


def test_leaks_and_paraphrases_are_found_and_clean_texts_left(spark):
    rnd = random.Random(9)

    def prose(n):
        return [rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.4 else f"w{rnd.randint(0, 10**7)}" for _ in range(n)]

    items = [prose(n) for n in (15, 30, 60, 150)]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (None, "a b c d e f g h i j")], "item_id bigint, text string")
    rows, expected = [], set()
    for i, item in enumerate(items):
        rows.append((i, " ".join(prose(300) + item + prose(200))))
        changed = [w if rnd.random() > 0.15 else f"v{rnd.randint(0, 10**6)}" for w in item]
        rows.append((10 + i, " ".join(prose(40) + changed + prose(40))))
        expected |= {(i, i), (10 + i, i)}
    rows += [(50 + i, " ".join(prose(400))) for i in range(40)] + [(200, None), (201, ""), (202, LONG)]
    df = docs(spark, rows)
    blocks = decontaminate.fit_passages(df, "text", benchmark, "item_id", "text")
    found = decontaminate.find_leaks(df, "text", blocks, "found")
    assert found.columns == [*df.columns, "found"]
    got = {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["found"]}
    assert got == expected
    none = decontaminate.find_leaks(df, "text", decontaminate.fit_passages(df, "text", benchmark.limit(0), "item_id", "text"), "found")
    assert none.where("size(found) > 0").count() == 0 and none.count() == len(rows)
    assert decontaminate.find_leaks(df.limit(0), "text", blocks, "found").count() == 0


def test_items_of_one_and_two_words_are_found(spark):
    items = ["perihelion", "quokka zygote", "the", "zygote quokka", "Perihelion", "again again", " ".join(f"w{i}" for i in range(20))]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = ["at the perihelion of it", "a Quokka, zygote.", "quokka x zygote", "quokka x y zygote", "zygote", "again", "again again", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"plain words number {i} of many") for i in range(60)]
    df = docs(spark, rows)
    blocks = decontaminate.fit_passages(df, "text", benchmark, "item_id", "text")
    found = decontaminate.find_leaks(df.select("doc_id", "text"), "text", blocks).select("doc_id", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 0), (0, 2), (0, 4), (1, 1), (2, 1), (6, 5)}
    assert {r["lcs"] for r in found} == {1.0}


def test_verbatim_leaks_of_a_benchmark_beyond_the_rank_equal_all_pairs(spark):
    rnd = random.Random(11)
    topics = [[f"t{i}x{k}" for k in range(40)] for i in range(300)]  # more than the rank
    items = [rnd.sample(topics[i % 300], 24) for i in range(3000)]
    for i in range(0, 3000, 10):  # mostly words that no other item uses
        items[i] = [f"u{i}x{k}" for k in range(rnd.choice([9, 17, 33]))]
    texts = [rnd.choices(rnd.choice(topics), k=100) for _ in range(60)]
    for t in range(50):
        item = items[rnd.randrange(0, 3000, 10) if t < 35 else rnd.randrange(3000)]
        at = rnd.randrange(60)
        texts[t][at:at] = item if t % 3 else [w for k, w in enumerate(item) if k % 5 != 2]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    df = docs(spark, [(t, " ".join(w)) for t, w in enumerate(texts)])
    hashed = [words([" ".join(w)])[0] for w in items]
    wanted = {(t, i) for t, text in enumerate(texts) for h in [words([" ".join(text)])[0]] for i, own in enumerate(hashed) if decontaminate.lcs_length(own, h) >= decontaminate.VERBATIM * len(own)}
    blocks = decontaminate.fit_passages(df, "text", benchmark, "item_id", "text")
    found = decontaminate.find_leaks(df.select("doc_id", "text"), "text", blocks).select("doc_id", F.inline("leaks")).collect()
    assert len(wanted) >= 50 and {(r["doc_id"], r["item_id"]) for r in found if r["lcs"] >= decontaminate.VERBATIM} == wanted


# ---------------------------------------------------------------- language and toxicity


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in entry_point.queries()["op8_language"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(got) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark):
    df = spark.createDataFrame([("der die das und nicht", "de"), ("the and of with that", "en")] * 40 + [("x", None), (None, "en")], "text string, lang string")
    model = langid.fit_language_model(df, "text", "lang")
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !? 😀"), (4, "und nicht die"), (5, "that with the"), (6, "the and of " * 50_000)])
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict_language(odd, model, "text").collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6)] == ["de", "en", "en"] and got[6][1] > 0.9
    untaught = langid.fit_language_model(df.limit(0), "text", "lang")
    assert {r["lang_pred"] for r in langid.predict_language(odd, untaught, "text").collect()} == {"und"}
    assert langid.predict_language(odd.limit(0), model, "text").count() == 0


def toxic_table(spark, n=900):
    rnd = random.Random(7)
    bad = ["slime", "dolt", "wretch", "oaf"]
    rows = []
    for i in range(n):
        toxic = int(rnd.random() < 0.2)
        text = [rnd.choice(["the", "of", "a"]) if rnd.random() < 0.4 else f"w{rnd.randint(0, 20000)}" for _ in range(rnd.choice([10, 80, 400]))]
        for _ in range(2 * toxic):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)


def test_toxicity_on_held_out_rows(spark):
    df = toxic_table(spark)
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id bigint, toxic int"))
    model = toxicity.fit_toxicity(toxicity.labelled(df, labels, "doc_id", "text", "toxic", F.col("doc_id") % 4 != 0))
    held = toxicity.score_toxicity(df.where("doc_id % 4 = 0"), model, "text").collect()
    assert np.mean([(r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in held]) > 0.97
    odd = docs(spark, [(1, None), (2, ""), (3, LONG), (4, "slime " + LONG), (5, "oaf")])
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(odd, model, "text").collect()}
    assert max(got[1], got[2], got[3]) < 0.5 < min(got[4], got[5]) and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_both_classes(spark):
    df = toxic_table(spark, 40)
    for labels in (df.select("doc_id", F.lit(0).alias("toxic")), df.select("doc_id", "toxic").limit(0)):
        model = toxicity.fit_toxicity(toxicity.labelled(df, labels, "doc_id", "text", "toxic", F.lit(True)))
        assert {round(r["toxicity"], 6) for r in toxicity.score_toxicity(df, model, "text").collect()} == {0.0}


def plain_counts(rows):
    """Documents of both classes with each word and each pair, from (text, toxic) rows."""
    n, pairs = (defaultdict(lambda: [0, 0]) for _ in range(2))
    for text, toxic in rows:
        found = re.findall(r"\w+", text.lower())
        for w in set(found):
            n[w][toxic] += 1
        for p in set(zip(["", *found], found, strict=False)):
            pairs[p][toxic] += 1
    return n, pairs


def plain_likelihoods(rows, d, stands):
    """Difference of log-likelihoods of every word and pair; ``stands`` are the continuation counts."""
    n, pairs = plain_counts(rows)

    def discounted(counts):
        mass = [sum(max(x[c] - d, 0) for x in counts) for c in (0, 1)]
        return mass, sum(min(sum(x), 2 * d) for x in counts) / max(1, sum(map(sum, counts)))

    mass, g = discounted(n.values())
    if not all(mass):
        return {}, {}
    p = {w: [(1 - g) * max(n[w][c] - d, 0) / mass[c] + g * stands[w] / sum(stands.values()) for c in (0, 1)] for w in stands}
    own, contexts = {}, defaultdict(list)
    for (v, _), x in pairs.items():
        contexts[v].append(x)
    shares = {v: discounted(x) for v, x in contexts.items()}
    for (v, w), x in pairs.items():
        m, gv = shares[v]
        if all(m):
            q = [(1 - gv) * max(x[c] - d, 0) / m[c] + gv * p[w][c] for c in (0, 1)]
            own[v, w] = math.log(q[1] / q[0])
    return {w: math.log(x[1] / x[0]) for w, x in p.items()}, own


def plain_features(text, by_word, by_pair):
    found = re.findall(r"\w+", text.lower())
    x = [by_pair.get(p, by_word.get(p[1], 0.0)) for p in zip(["", *found], found, strict=False)]
    if not x:
        return [0.0] * 4
    return [max(sum(x[i : i + k]) / k for i in range(len(x))) for k in (1, 4, 16)] + [sum(x) / len(x)]


def test_toxicity_equals_a_plain_kneser_ney(spark, monkeypatch):
    rnd = random.Random(11)
    texts = {" ".join(rnd.choice(["a", "b", "c", "d"]) if rnd.random() < 0.5 else f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(rnd.choice([1, 5, 60]))) for _ in range(400)}
    df = spark.createDataFrame([(i, t, int(rnd.random() < 0.1 + 0.4 * ("b c" in t))) for i, t in enumerate(sorted(texts))], "doc_id bigint, text string, toxic int").repartition(3)
    rows = toxicity.labelled(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", F.lit(True))
    seen, fit = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append((x, y)) or fit(x, y))
    model = toxicity.fit_toxicity(rows)
    taught = [(r["text"], r["toxic"], r["fold"]) for r in rows.collect()]
    _, pairs = plain_counts([t[:2] for t in taught])
    stands = Counter(w for _, w in pairs)

    for d, (x, y) in zip(toxicity.DISCOUNTS, seen, strict=True):
        likelihoods = [plain_likelihoods([t[:2] for t in taught if t[2] != f], d, stands) for f in range(toxicity.FOLDS)]
        want = sorted((c, *plain_features(t, *likelihoods[f])) for t, c, f in taught)
        got = sorted((c, *z) for c, z in zip(y, x, strict=True))
        assert len(got) == len(want) > 250
        assert np.allclose(np.sort(np.array(got), axis=0), np.sort(np.array(want), axis=0), atol=1e-5)
    by_word, by_pair = plain_likelihoods([t[:2] for t in taught], model.discount, stands)
    held = dict(zip(model.keys.tolist(), model.values.tolist(), strict=True))

    def key(text):
        hashes, before, _ = toxicity.expressions([text])
        return hashes[-1], toxicity.pair_key(before, hashes)[-1]

    assert held and len(by_pair) > 100
    for w, x in by_word.items():
        assert math.isclose(held.get(int(key(w)[0]), 0.0), x, abs_tol=1e-5), w
    for (v, w), x in by_pair.items():
        word, pair = key(f"{v} {w}")
        assert math.isclose(held.get(int(pair), held.get(int(word), 0.0)), x, abs_tol=1e-5), (v, w)


def test_toxicity_of_pairs_after_rare_words(spark):
    """Only pairs tell, and 5,000 words are more frequent than those the pairs begin with."""
    rnd = random.Random(3)
    rows = []
    for i in range(800):
        toxic, k = int(i % 4 == 0), rnd.randrange(8)
        text = [f"w{rnd.randrange(5000)}" for _ in range(500)]
        if i % 4 < 2:
            for v, w in ((f"v{k}", f"{'xy'[toxic]}{k}"), (f"u{k}", f"{'yx'[toxic]}{k}")):
                text.insert(rnd.randrange(1, len(text)), f"{v} {w}")
        rows.append((i, " ".join(text), toxic))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    model = toxicity.fit_toxicity(toxicity.labelled(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", F.col("doc_id") % 16 >= 4))
    held = toxicity.score_toxicity(df.where("doc_id % 16 < 4"), model, "text").collect()
    assert np.mean([(r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in held]) > 0.97


def test_toxicity_of_entries_beyond_those_held(spark, monkeypatch):
    df = toxic_table(spark)
    df = df.union(df.where("doc_id = 3").crossJoin(spark.range(40)).selectExpr("1000 + id", "text", "toxic")).unionByName(spark.createDataFrame([(2000, None, 0), (2001, "", 0)], df.schema))
    monkeypatch.setattr(toxicity, "HELD", 30)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 1 << 17)
    part = toxicity.fit_toxicity(toxicity.labelled(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", F.lit(True)))
    rest = part.rest.toPandas()
    assert len(part.keys) <= 30 < len(rest)
    keys = np.concatenate([part.keys, rest["key"].to_numpy().view(np.uint64)])
    order = np.argsort(keys)
    whole = toxicity.ToxicityModel(keys[order], np.concatenate([part.values, rest["x"].to_numpy()])[order], part.weights, part.bias)
    got, want = (sorted(map(tuple, toxicity.score_toxicity(df, m, "text").collect()), key=str) for m in (part, whole))
    assert got == want and len(got) == df.count()
    few = toxicity.ToxicityModel(part.keys, part.values, part.weights, part.bias)
    assert got != sorted(map(tuple, toxicity.score_toxicity(df, few, "text").collect()), key=str)


def test_hashes_of_runs_equal_the_plain_polynomial():
    rnd = random.Random(5)
    lengths = [1, 7, LONG_RUN, LONG_RUN + 1, 1, 3 * LONG_RUN + 5, *[rnd.randrange(1, 12) for _ in range(20_000)]]
    starts = np.cumsum([n + 1 for n in lengths]) - np.array(lengths) - 1
    ends = starts + lengths
    codes = np.array([rnd.randrange(0x110000) for _ in range(ends[-1] + 3)], np.uint32)
    sums = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        sums.append(sum((c + 1) * (pow(0x9E3779B97F4A7C15, i % 1024, 1 << 64) + i // 1024) for i, c in enumerate(codes[s:e].tolist())) % (1 << 64))
    assert run_hashes(codes, starts, ends).tolist() == mix(np.array(sums, np.uint64)).tolist()


def plan_nodes(df):
    return re.findall(r"^[\s:+*()\d-]*(\w+)", df._jdf.queryExecution().executedPlan().toString(), re.M)


@pytest.mark.parametrize("pairs", [True, False])
def test_toxicity_counts_are_dealt_out_before_spark_sums_them(spark, pairs):
    df = toxic_table(spark, 40)
    nodes = plan_nodes(toxicity._counted(toxicity.labelled(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", F.lit(True)), pairs))
    dealt = nodes.index("Exchange")
    assert "HashAggregate" in nodes[:dealt] and nodes.index("MapInArrow") > dealt
    assert not any(n.endswith("Aggregate") for n in nodes[dealt : nodes.index("MapInArrow")])


def test_toxicity_contexts_have_the_masses_of_each_fold(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(12), w, *[int(rnd.paretovariate(0.6)) % 90 - 1 for _ in range(2 * toxicity.FOLDS)]) for w in range(150)]
    pairs = [(v, w, *[max(n, 0) for n in x]) for v, w, *x in pairs] + [(50, 0, 1, 0, 0, 0, 1, 0, 0, 0), (51, 0, 9, 9, 9, 9, 0, 0, 0, 0), (52, 0, 9, 9, 9, 9, 3, 0, 0, 0)]
    df = spark.createDataFrame(pairs, ", ".join(["v bigint", "w bigint", *[f"{n} bigint" for n in toxicity.COUNTS]]))
    want = {}
    for f in range(toxicity.FOLDS):
        others = [(v, *[sum(x[c * toxicity.FOLDS + g] for g in range(toxicity.FOLDS) if g != f) for c in (0, 1)]) for v, _, *x in pairs]
        for v in {p[0] for p in pairs}:
            masses = [sum(max(x, 0.0) for x in of) for d in toxicity.DISCOUNTS for of in zip(*[(a - d, b - d, a + b - 2 * d) for u, a, b in others if u == v], strict=True)]
            if masses[0] > 0 and masses[1] > 0:
                want.setdefault(v, {})[f] = masses
    contexts = toxicity._contexts(df)
    assert {r["key"]: r["masses"] for r in contexts.collect()} == want and 51 not in want and sorted(want[52]) == [1, 2, 3]
    # Sums for all folds and discounts at once make code too long to be compiled.
    assert max(line.count("partial_sum") for line in contexts._jdf.queryExecution().executedPlan().toString().split("\n")) == 3 * len(toxicity.DISCOUNTS)


def test_toxicity_gives_back_no_text_that_nobody_keeps(spark):
    df = toxic_table(spark, 200).withColumn("more", F.lit("x"))
    model = toxicity.fit_toxicity(toxicity.labelled(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", F.lit(True)))
    whole, narrow = (toxicity.score_toxicity(df, model, "text", "score", *keep) for keep in ([], [["toxic", "doc_id"]]))
    assert whole.columns == ["doc_id", "text", "toxic", "more", "score"] and narrow.columns == ["toxic", "doc_id", "score"]
    assert sorted(narrow.collect()) == sorted(whole.select(narrow.columns).collect())
    of = re.search(r"MapInArrow run.*|MapInArrow .*", entry_point.queries()["op1_toxicity"](spark, SF)._jdf.queryExecution().executedPlan().toString())[0]
    assert "doc_id" in of.rsplit("[", 1)[1] and "text" not in of.rsplit("[", 1)[1]


def test_toxicity_pairs_leave_their_task_in_narrow_rows(spark):
    df = toxic_table(spark, 60)
    counted = toxicity._counted(toxicity.labelled(df, df.select("doc_id", "toxic"), "doc_id", "text", "toxic", F.lit(True)), True)
    sent = re.search(r"MapInArrow .*\[([^\]]*)\], ", counted._jdf.queryExecution().executedPlan().toString())[1]
    assert re.findall(r"(\w+)#", sent) == ["v", "w", "kind", "n"]
    n, pairs = plain_counts([(r["text"], r["toxic"]) for r in df.collect()])
    got = counted.collect()
    assert len(got) == len(pairs) and sorted(sum(r[c] for c in toxicity.COUNTS) for r in got) == sorted(map(sum, pairs.values()))


def test_toxicity_wanted_entries_of_many_blocks(spark):
    df = toxic_table(spark, 200).withColumn("block", (F.col("doc_id") % 150).cast("int")).coalesce(1)
    rows = [(r["text"], r["block"]) for r in df.collect()]
    hashes, before, _ = toxicity.expressions([t for t, _ in rows])
    held = np.unique(hashes)[::3]
    marks = np.zeros(toxicity.SLOTS // 8, np.uint8)
    slots = np.unique(np.concatenate([hashes, toxicity.pair_key(before, hashes)])[::2]) & np.uint64(toxicity.SLOTS - 1)
    np.bitwise_or.at(marks, slots >> np.uint64(3), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
    want = set()
    for text, block in rows:
        words_of, first, _ = toxicity.expressions([text])
        keys = np.unique(np.concatenate([words_of, first, toxicity.pair_key(first, words_of)]))
        keys = keys[toxicity.marked(marks, keys) & ~np.isin(keys, held)]
        want.update((block, k) for k in keys.view(np.int64).tolist())
    got = [tuple(r) for r in toxicity._wanted(df, "text", "block", marks, held).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000
    model = toxicity.ToxicityModel(held)
    assert model.places is model.places and "places" not in vars(toxicity.ToxicityModel(held))
