"""Operators for training data against plain versions, and nulls, empty tables, ties and repeated rows."""

import math
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL

F_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{chr(97 + i // 20)}o{chr(97 + i % 20)}" for i in range(400)]


def text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


BASE, PASSAGE, LINE = text(1, 120), text(2, 60), "The same line here"
NEAR = BASE.split()
NEAR[7] = "changed"
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, " ".join(NEAR).upper(), "en", None, None), (4, None, None, None, None), (5, "", "en", "b", 0),
    (6, " \n\t ", "en", "b", 0), (7, "four words are here", "en", "b", 0), (8, "four words are here", "de", "c", 0), (9, "mail joe@ex.com or +1 (415) 555-2671 now", "en", "c", 0),
    (10, f"{text(3, 80)}\n{PASSAGE}\n{text(4, 30)}", "en", "c", 0), (11, f"{PASSAGE} {text(5, 40)}", "en", "c", 0), (12, "x" * 70_000, "en", "c", 0), (12, "x" * 70_000, "en", "c", 0),
    (None, BASE, "en", "a", 1), (13, text(6, 3000), "en", "d", 0), (14, "é " + "a b " * 200, "en", "d", 0),
] + [(20 + i, f"{text(30 + i, 20)}\n  {LINE.upper() if i % 2 else LINE}\t\n{text(60 + i, 9)}", "en", "e", 0) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, F_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], F_SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- 1 personal data ------------------------------------------------------------------------------------

def strict_spans(t):
    out = []
    for kind, form in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(form, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


HARD = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.0255", "4111 1111-1111 1111 5 4111111111111111 12", "+1 (415) 555-2671 +49-30 1234567. x",
        "😀 é joe@ex.com, +1234567", "a@b a@b.c. 1.2.3", "9" * 3000 + " 4111111111111111", "x" * 2000 + "@a.b " * 40, "5 5 5", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8"]


def test_strict_spans_and_redaction(spark, docs, none):
    from kickline.llm import pii
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(50, None), (51, HARD[0]), (52, "call (415) 555-2671 now and email joe [at] example [dot] com")], "doc_id long, text string")
    got = {r.doc_id: r._spans for r in pii.find(df).collect()}
    for i, t in enumerate(HARD):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == strict_spans(t), t[:60]
    assert got[50] == [] and got[51] == got[0]
    assert [(s.kind, s.base) for s in got[52]] == [("email", False), ("phone", False)]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[52] == "call <PHONE> now and email <EMAIL>" and clean[50] is None
    assert pii.redact(docs).count() == len(ROWS) and pii.find(none).count() == 0
    same = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert same[9] == "mail <EMAIL> or <PHONE> now" and same[1] == BASE


def test_clean_numbers_are_left_alone(spark):
    from kickline.llm import pii
    df = spark.createDataFrame([(1, "release version 1.2.300.4 of 2024-10-12"), (2, "order 1234567890123456 and 12 34 56")], "doc_id long, text string")
    assert all(r._spans == [] for r in pii.find(df).collect())


def test_compressed_addresses_and_overlaps(spark):
    from kickline.llm import pii
    df = spark.createDataFrame([(1, "server ip 2001:db8::1 and host fe80::1 here"), (2, "std::vector a::b, ratio 3::4 and 12:30:45 std::d::e"), (3, "seen 2001:db8:85a3::8a2e:370:7334 again")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r._spans] for r in pii.find(df).collect()}
    assert got == {1: [("ip", 10, 21), ("ip", 31, 38)], 2: [], 3: [("ip", 5, 33)]}
    model = pii.Model(start=9.0, thresholds=dict.fromkeys(pii.KINDS, 0.5))
    spans = [("email", 0, 0, 10), ("phone", 1, 5, 20), ("card", 1, 15, 25), ("card", 1, 30, 40), ("phone", 1, 30, 44), ("ip", 1, 42, 50), ("ip", 1, 44, 48)]
    rows = spark.createDataFrame([(1, k, loose, a, b, True if loose == 0 else None) for k, loose, a, b in spans], "k int, kind string, loose int, start long, end long, passed boolean")
    assert [(s.kind, s.start) for s in pii.accepted(rows, ["k"], model).first().spans] == [("email", 0), ("ip", 44), ("card", 15), ("phone", 30)]


def test_thresholds_do_not_depend_on_the_corpus_size(spark):
    from kickline.llm import pii
    texts = ["mail joe@ex.com or 1.2.3.4", "300.1.1.1 and 4111111111111111", "4111111111111112 or +14155552671", "+1 23 x"]
    told = []
    for times in (1, 50):
        df = spark.createDataFrame([(i, t) for i in range(times) for t in texts], "doc_id long, text string")
        told.append(pii.train(spark, pii.described(pii.candidates(df, "text", ["doc_id", "text"]))))
    assert told[0].thresholds == pytest.approx(told[1].thresholds, abs=1e-6) and max(told[0].thresholds.values()) < 1


def test_extra_columns_of_any_name(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from kickline.llm import line_dedup, pii, quality
    rows = [(i, f"{text(700 + i, 60)} joe{i}@ex.com", "h", i) for i in range(3)]
    names = ["spans", "gone", "_host", "_w", "_l", "_h", "_t1", "_k1", "_row", "_text", "_done", "h", "kind", "c0", "loose"]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "n"]).select("doc_id", "text", "source", *[F.col("n").alias(c) for c in names])
    kept = [(i, *[n] * len(names)) for i, _, _, n in rows]
    for got in (quality.judge(docs.withColumnRenamed("kind", "a.b")), line_dedup.drop_frequent_lines(docs.withColumnRenamed("kind", "a.b"))):
        assert got.columns[:3] == docs.columns[:3] and "a.b" in got.columns
        assert sorted((r[0], *r[3:3 + len(names)]) for r in got.collect()) == kept
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.line_dedup_stage):
        assert sorted((r[0], *r[3:]) for r in stage(spark, docs, "").collect()) == kept
    clean = pii.redact(docs).collect()
    assert sorted((r[0], *r[3:]) for r in clean) == kept and sorted(r[1] for r in clean) == sorted(t.split(" joe")[0] + " <EMAIL>" for _, t, _, _ in rows)


# -- 2 quality ------------------------------------------------------------------------------------------

def test_quality_statistics(docs, none):
    from kickline.llm import quality
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for doc_id, t, *_ in ROWS:
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[doc_id]
        assert (r._n_words, r._word_chars, r._n_dup_lines, r._n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit)), doc_id
        assert r._base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality.judge(none).count() == 0 and quality.judge(docs).count() == len(ROWS)


def test_depleted_documents_go_and_copies_do_not(spark):
    from kickline.llm import quality
    boiler = "\n".join(text(100 + i, 15) for i in range(6))
    rows = [(i, f"{boiler}\nid {'ab' * (i + 1)}", "h") for i in range(8)] + [(50 + i, "\n".join(text(200 + k, 15) for k in range(6)), "h") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r._kept for r in quality.judge(df, line_texts=5).collect()}
    assert not any(got[i] for i in range(8)) and all(got[50 + i] for i in range(8))


def test_near_copies_do_not_reject_each_other(spark):
    from kickline.llm import quality
    body = [text(300 + k, 15) for k in range(6)]
    rows = [(i, "\n".join(f"{x.upper() if (i + k) % 3 == 0 else x} {i * 7 + k}" for k, x in enumerate(body)), "h") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len({t for _, t, _ in rows}) == 60 and all(r._kept for r in quality.judge(df).collect())


def test_boilerplate_lines_are_removed(spark):
    import corpus_pipeline
    from kickline.llm import quality
    boiler = "\n".join(text(400 + i, 15) for i in range(4))
    rows = [(i, f"{boiler}\n\n{text(500 + i, 70 if i < 60 else 49)}\n", "en", "h", 0) for i in range(64)] + [(90, f"{boiler}\n{text(600, 70)}", "en", "g", 0)]
    df = spark.createDataFrame([*rows, rows[0], rows[60]], F_SCHEMA)
    out = corpus_pipeline.quality_rules(spark, df, "").collect()
    want = {i: "\n" + text(500 + i, 70) + "\n" for i in range(60)} | {90: rows[64][1]}  # 60 of 109 words are boilerplate from 60 on, 49 are left
    assert len(out) == 62 and {r.doc_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)
    got = {r.doc_id: (r._n_left, r._kept) for r in quality.judge(df, keep_text=False).collect()}
    assert got[0] == (70, True) and got[60] == (49, False) and got[90] == (130, True)


# -- 3 lines --------------------------------------------------------------------------------------------

def test_line_dedup(docs, none):
    from kickline.llm import line_dedup
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for _, t, *_ in ROWS for k in {key(x) for x in (t or "").split("\n")} if k)
    got = defaultdict(list)
    for r in line_dedup.drop_frequent_lines(docs).collect():
        got[r.doc_id].append((r.text, r._n_lines, r._n_dropped))
    for doc_id, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < 10]
        assert ("\n".join(kept), len(lines), len(lines) - len(kept)) in got[doc_id]
    assert sum(map(len, got.values())) == len(ROWS)
    assert any(n for rows in got.values() for _, _, n in rows)
    assert line_dedup.drop_frequent_lines(none).count() == 0


def test_perfect_hash_is_minimal():
    from kickline.llm.line_dedup import PerfectHash
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64))
    mph = PerfectHash.unpacked(*PerfectHash.build(keys).packed())
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))


# -- 4 toxicity -----------------------------------------------------------------------------------------

def test_toxicity_learns_and_ignores_group_names(spark, none):
    from kickline.llm import toxicity
    names = "muslim christian jewish hindu".split()
    rows = [(i, f"{text(500 + i, 30)} {'horrid nasty vile'.split()[i % 3] if i % 4 == 0 else 'plain'} {names[0] if i % 4 == 0 else names[i % 4]} people {text(900 + i, 5)}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    got = {r.doc_id: r._score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held) and len(got) == 402 and 0 <= got[1000] <= 1
    w = [model[0][toxicity.bucket_of(n.encode())] for n in names]
    assert max(w) - min(w) < 0.5  # the label follows the name in these rows, the penalty keeps it small
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0


def test_whole_scores_hold_under_swapped_names():
    from kickline.llm import toxicity
    # the label follows the name in these rows; next to it stand words that tell the labels apart as well
    for line in ("muslims christians jews hindus buddhists", "immigrants foreigners refugees citizens", "women men"):
        names = line.split()
        rows = [(f"{text(500 + i, 30)} {'horrid nasty vile'.split()[i % 3] if i % 4 == 0 else 'plain'} {names[0] if i % 4 == 0 else names[1 + i % (len(names) - 1)]} people", i % 4 == 0) for i in range(400)]
        weights, bias = toxicity.fit([toxicity.buckets(t.encode()) for t, _ in rows], np.array([y for _, y in rows], float))
        for form in ("the {} came home today", "the {}' house", "the {}'s house", "the {}\u2019s house", "(The {}), not others"):
            z = [weights[toxicity.buckets(form.format(n if form[0] == "t" else n.title()).encode())].sum() + bias for n in names]
            assert max(z) - min(z) < 0.5, (line, form, z)
    # a text that holds both names loses the one that is swapped
    pairs = {(a, b): n for a, b, n in toxicity.swaps([toxicity.buckets(t) for t in (b"women men", b"women", b"women's men's", b"old")]) if n}
    w, m = toxicity.bucket_of(b"women"), toxicity.bucket_of(b"men")
    assert pairs[w, m] == 1 and pairs[w, -1] == 2 and pairs[m, -1] == 2 and (m, w) not in pairs


def test_toxicity_on_held_out_rows(spark):
    from kickline.llm.registry import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank, bad = got.score.rank(), got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.9


# -- 5 urls ---------------------------------------------------------------------------------------------

def test_urls(spark):
    from kickline.llm import url_filter
    rows = [(1, "https://WWW.Example.com/en/5?x#y"), (2, "http://a.example.com/en/5"), (3, "http://b.net/es/1"), (4, "http://b.net/de/1"), (5, "no url"), (6, None), (7, "ftp://x.com"),
            (8, "http://x.com/?q"), (9, "http://example.com/en/"), (10, "https://www.casino-win.example.net/de/1"), (11, "http://net/fr/"), (12, "http://" + "h" * 5000 + ".org/a")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r._host, r._path, r._rule, r._verdict) for r in url_filter.judge(df, url_filter.fit(url_filter.labelled_urls(spark), apart="words")).collect()}
    assert got[1] == ("www.example.com", "/en/5", "www.example.com/en/", "allow") and got[2] == ("a.example.com", "/en/5", "example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("b.net", "/de/1", None) and got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][1:3] == ("", None) and got[8][1:] == ("/", "com/", "allow") and got[9][2] == "example.com/en/" and got[10][2:] == (None, "block") and got[11][2] == "net/fr/"
    assert len(got) == len(rows)


def plain_url_score(host, path, model):
    import xxhash
    lower = lambda x: x.translate({c: c + 32 for c in range(65, 91)})
    found = set()
    for part, whole in (("h", f".{host}/"), ("p", lower(path))):
        for n in (3, 4, 5):
            for i in range(len(whole) - n + 1):
                found.add(xxhash.xxh64_intdigest(whole[i:i + n].encode(), seed=xxhash.xxh64_intdigest(part.encode(), seed=42)) % (1 << 64))
    from kickline.llm.url_filter import BUCKETS
    buckets = {(h - (1 << 64) if h >> 63 else h) % BUCKETS for h in found}
    weights, bias = model
    return 1 / (1 + math.exp(-(sum(float(f"{weights[b]:.9g}") for b in buckets) / math.sqrt(max(1, len(buckets))) + bias)))


def test_url_scores_and_rules_equal_a_plain_version(spark):
    from kickline.llm import url_filter
    model = url_filter.fit(url_filter.labelled_urls(spark), apart="words")
    hosts = ["", "Net", "x.net", "notnet", "www.example.com", "a.www.example.com", "example.com.org", "Straße.org", "b" * 4000 + ".org", "casino.info:80", "u@h.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/ES/1", "/es/?a=/fr/", "/fr/#x", "?/en/", "/en/\n/x://y")]
    df = spark.createDataFrame([(u, None, 1) for u in [*urls, urls[0], "", "://"]], "url string, _said string, `a.b` int")
    out = url_filter.judge(df, model).collect()
    assert len(out) == len(urls) + 3
    for r in out:
        rest = r.url.split("://", 1)[1] if "://" in r.url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, said) for said, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, said = max(fits)[1:] if fits else (None, None)
        assert (r._host, r._path, r._rule) == (host, path, rule)
        if rule:
            assert r._verdict == said and r._score is None
        else:
            want = plain_url_score(host, path, model)
            assert abs(r._score - want) < 1e-6 and (abs(want - 0.5) < 1e-6 or r._verdict == ("block" if want >= 0.5 else "allow"))
    assert url_filter.judge(df.limit(0), model).count() == 0


#: Hosts written after the labelled table was settled, none of them in it: some of the blocked ones hold no word of the table at all.
UNSEEN_BLOCKED = """
viagra-discounter.com big-jackpot-slots.net paydayfastloans.info lucky-casino.org xxx-webcams.com cheapreplicas.net cryptoprofits.org torrentcracks.info
freeprizes.net adtrackers.com hotnudes.org pokerbonus.co.uk baccarat-king.org tramadol-express.com botox-bargain.net malware-drop.info hookup-tonight.com blackjack-lounge.de
getrichquick.org hair-regrowth-secret.com
"""
UNSEEN_ALLOWED = """
rowing-association.org cathedral-choir.co.uk lakeside-primary.org astronomy-now.net vegetable-growers.com oxford-botany.org pottery-class.info norwegian-fjords.com chemistry-review.org
railway-heritage.co.uk volleyball-league.de hospital-trust.org translation-service.net bicycle-repair.com novel-readers.org wetterdienst.de municipal-archive.es cuisine-du-monde.com
violin-teacher.net glacier-research.org
"""


def test_urls_of_unseen_hosts(spark):
    from kickline.llm import url_filter
    labelled = url_filter.labelled_urls(spark)
    table = " ".join(r.url for r in labelled.collect())
    unseen = [(h, 1) for h in UNSEEN_BLOCKED.split()] + [(h, 0) for h in UNSEEN_ALLOWED.split()]
    assert not any(h in table for h, _ in unseen)
    df = spark.createDataFrame([(f"https://www.{h}/en/77.html", y) for h, y in unseen], "url string, y int")
    got = [(r.y, r._verdict == "block") for r in url_filter.judge(df, url_filter.fit(labelled, apart="words"), rules=()).collect()]
    blocked, alarms = sum(b for y, b in got if y), sum(b for y, b in got if not y)
    print("unseen hosts: blocked", blocked, "false alarms", alarms)
    assert blocked >= 10 and alarms <= 2


def test_url_cut_off():
    import numpy as np
    from kickline.llm.url_filter import FALSE_ALARM, cut_off
    rng = np.random.default_rng(3)
    for n in (2, 5, 40):
        z, y = rng.normal(size=n).round(1), np.array([1, 0] * n)[:n].astype(float)
        cost = lambda c: (z[y > 0] < c).mean() + FALSE_ALARM * (z[y == 0] >= c).mean()
        if len(set(z)) == n:
            assert abs(cost(cut_off(z, y)) - min(cost(c) for c in [*(z - 1e-6), z.max() + 1])) < 1e-9


# -- 6 encoding -----------------------------------------------------------------------------------------

def test_encoding_equals_the_library(docs, none):
    import public_tokenizers as P
    from kickline.llm import bpe
    for name, leaf in (("word_bpe_49k.json", 300), ("word_bpe_49k.json", bpe.LEAF_CHARS), ("byte_bpe_50k.json", 300)):
        path = P.path(name)
        model = bpe.tokenizer(path)
        got = defaultdict(list)
        for r in bpe.encode(docs, path, leaf_chars=leaf).collect():
            got[r.doc_id].append(r)
        for doc_id, t, *_ in ROWS:
            ids = model.encode(t or "", add_special_tokens=False).ids
            assert all(r._ids == ids and r._decoded == model.decode(ids, skip_special_tokens=False) for r in got[doc_id])
        assert sum(map(len, got.values())) == len(ROWS)
        assert bpe.encode(none, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_agree_wherever_a_text_is_cut(name):
    import public_tokenizers as P
    from kickline.llm import bpe
    path = P.path(name)
    odd = "don't <|endoftext|> 12345 néé ÀÉ  \n\n\t  x" * 40 + "ab" * 700 + " " * 300 + "😀é" * 90 + text(8, 200)
    whole = bpe.tokenizer(path).encode(odd, add_special_tokens=False).ids
    for leaf in (90, 333, 1000):
        parts = [bpe.Part.of(odd[a:b], a, path) for a, b in bpe.halves(len(odd), leaf)]
        assert bpe.join_tree(parts, odd, path).ids.tolist() == whole


# -- 7 neighbours ---------------------------------------------------------------------------------------

def test_neighbours(spark):
    from kickline.llm import ann
    from pyspark.sql import functions as F
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(60)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [1.0] * 7 + [float("nan")]), (905, [1.0] * 3), (None, [1.0] * 8), rows[20]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in ann.search(df, F.col("vec_id") % 20 == 0, 5, share=1.0, block=50).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for q, v in rows[::20]:
        want = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in sorted((round(s, 9), i) for s, i in want)] and np.allclose([s for _, s in got[q]], [-s for s, _ in want])
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert ann.search(few, F.col("vec_id") % 20 == 0, 20).count() == 4
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_recall(spark):
    from kickline.llm.registry import QUERIES
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = QUERIES["op7_inverted_multi_index"](spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    hits = 0
    for q in got.index:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hits >= 0.9 * 20 * len(got)


# -- 8 repeats ------------------------------------------------------------------------------------------

def test_repeats(docs, none):
    from kickline.llm import substring_dedup
    first = {}
    for doc_id, t, *_ in ROWS:
        w = words(t)
        for i in range(len(w) - 49):
            if doc_id is not None:
                k = tuple(w[i:i + 50])
                first[k] = min(first.get(k, doc_id), doc_id)
    got = defaultdict(list)
    for r in substring_dedup.remove_repeats(docs).collect():
        got[r.doc_id].append((r._n_words, r._n_removed, r.text))
    for doc_id, t, *_ in ROWS:
        w = words(t)
        gone = set()
        for i in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[i:i + 50])] < doc_id:
                gone.update(range(i, i + 50))
        assert (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)) in got[doc_id], doc_id
    assert got[11][0][1] == 60 and sum(map(len, got.values())) == len(ROWS)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_cover_meets_every_shift():
    from kickline.llm.substring_dedup import COVER, PERIOD
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


# -- 9 packing ------------------------------------------------------------------------------------------

def test_packing(docs, none):
    from kickline.llm import packing
    v = packing.vocabulary()
    rows = packing.pack_documents(docs, **v).toPandas()
    model = packing.tokenizer(v["path"])
    for doc_id, t, *_ in ROWS:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = rows[rows.doc_id == doc_id] if doc_id is not None else rows[rows.doc_id.isna()]
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
        assert own.length.sum() == len(ids) * sum(r[0] == doc_id for r in ROWS)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and rows.groupby("sequence_id").length.sum().max() <= 2048
    assert rows.sequence_id.nunique() == packing.lower_bound(rows.length.to_numpy(), 2048)
    assert packing.pack_documents(none, **v).count() == 0


def test_exchange_keeps_every_piece(spark):
    from kickline.llm import packing
    r = np.random.default_rng(9)
    rows = [(i, int(n)) for i, n in enumerate(r.integers(300, 900, 400))]
    got = packing.pack(spark.createDataFrame(rows, "_item long, length long"), per_partition=40).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got._item) == list(range(400)) and (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 11 / 9 * packing.lower_bound(got.length.to_numpy(), 2048) + 1  # best-fit decreasing's guarantee


def test_bounds_hold():
    from kickline.llm.packing import best_fit_decreasing, lower_bound
    r = np.random.default_rng(2)
    for _ in range(60):
        own = r.integers(1, 60, r.integers(1, 40))
        assert lower_bound(own, 60) <= best_fit_decreasing(own, 60)[2]
    assert lower_bound(np.array([31] * 7), 60) == 7


# -- 10 near copies -------------------------------------------------------------------------------------

def test_near_duplicates(spark, docs, none):
    from kickline.llm import near_dedup

    def shingles(t):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    rows = [r[:2] for r in ROWS if r[0] is not None]
    for k in range(60):  # a group whose members are near the first, not always near each other
        w = text(77, 150).split()
        for at in np.random.default_rng(k).choice(150, k % 6, replace=False):
            w[at] = f"z{k}"
        rows.append((100 + k, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    least = {x: min(rows[i][0] for i in range(len(rows)) if root[i] == x) for x in set(root)}
    df = spark.createDataFrame(rows + [(None, BASE)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(df).collect()}
    for i, (doc_id, _) in enumerate(rows):
        r = got[doc_id, len(sets[i])]
        assert r.component_id == least[root[i]] and r.kept == (doc_id == r.component_id), doc_id
    assert got[None, len(sets[0])].kept and got[None, len(sets[0])].component_id is None
    assert near_dedup.near_duplicates(none).count() == 0


def test_marks_are_as_large_as_the_pairs_ask_for(spark, monkeypatch):
    from kickline.llm import near_dedup
    df = spark.createDataFrame([(i, text(300 + i // 4, 60) + " end" * (i % 4)) for i in range(40)], "doc_id long, text string")
    asked, of = [], near_dedup.Bitmap.of

    def noted(rows, column, bits=1 << 26):
        asked.append(bits)
        return of(rows, column, bits)

    monkeypatch.setattr(near_dedup.Bitmap, "of", noted)
    found = [sorted(map(tuple, near_dedup.near_duplicates(df).collect()))]
    assert asked and max(asked) <= 1 << 20
    # bits that are nearly all set only let more rows pass
    monkeypatch.setattr(near_dedup, "MARKS", 64)
    found.append(sorted(map(tuple, near_dedup.near_duplicates(df).collect())))
    assert min(asked) == 64 and found[0] == found[1] and {r[2] for r in found[0]} == set(range(0, 40, 4))


def test_long_rows_travel_in_small_batches(spark):
    import pyarrow as pa

    from kickline.session import BATCH_BYTES, ship
    df = spark.createDataFrame([(i, "x" * 40_000) for i in range(400)], "doc_id long, text string").coalesce(1)
    sizes = lambda: [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    ship(spark)
    got = sizes()
    assert sum(got) > 400 * 40_000 and max(got) < BATCH_BYTES + 100_000


# -- the whole --------------------------------------------------------------------------------------------

def test_sql_twins(spark):
    import corpus_pipeline  # noqa: F401  registers every query
    from kickline.llm.registry import ORACLE, QUERIES
    from tests.oracle_check import compare, connect
    con = connect(SMALL)
    for name in ("op2_quality_rules", "op3_line_dedup"):
        ok, message = compare(spark, con, SMALL, name, QUERIES[name], ORACLE[name])
        assert ok, message


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as c
    now = docs
    ids = []
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns, name
        path = c.scratch_path(spark, name)
        now.write.parquet(path)
        now = spark.read.parquet(path)
        ids.append(sorted((r.doc_id for r in now.select("doc_id").collect()), key=str))
    assert 7 not in ids[0] and 1 in ids[0] and ids[1] == ids[0] and {2, 3} & set(ids[2]) == set() and 1 in ids[2]
    assert set(c.STAGES[-1][1](spark, now, "").toPandas().doc_id.dropna()) == set(x for x in ids[-1] if x is not None)
    for _, stage in c.STAGES:
        none = stage(spark, none, "") if none.columns == docs.columns else none
    assert none.count() == 0


def test_sha256_of_kept_lines(spark):
    from kickline.llm.registry import QUERIES
    got = QUERIES["op3_line_dedup"](spark, SMALL).limit(5).collect()
    assert all(len(r.kept_sha256) == len(hashlib.sha256(b"").hexdigest()) for r in got)
