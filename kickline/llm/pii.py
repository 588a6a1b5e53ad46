"""Personal data: candidate spans, boosted trees on format and context, calibrated thresholds.

Generators of high recall propose spans, the strict forms among them, and may overlap. Every
candidate is described by a few small numbers about its format and the words around it. Trees are
boosted on counts per combination of these numbers: over all of the corpus, where strict forms that
pass their check are positive and those that fail are negative, and over a small written table that
knows the looser forms. A threshold per kind is set where labelled candidates at or above it are
right often enough. Strict forms that pass always stay; looser candidates that reach the threshold and overlap
nothing accepted join them. All work on texts is done by built-in functions; only the bounded table of
combinations comes to the driver.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kickline.llm.common import aside, restored, row_key, table
from kickline.llm.registry import query
from kickline.session import stage

KINDS = ("email", "ip", "card", "phone")

#: Strict forms (fixed by the contract), written so that a search never looks at a character twice:
#: a run is entered at its first character only. \G is the end of the match before.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Za-z_:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z_:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[./_]|\x20-\x20)[0-9]{4}(?:[./_]|\x20-\x20)[0-9]{4}(?:[./_]|\x20-\x20)[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: A cheap test that a text can hold the form at all.
NEEDS = {("email", 0): "@", ("email", 1): r"@|\(at\)|\[at\]|\{at\}|\x20at\x20", ("ip", 0): r"[0-9]\.[0-9]", ("ip", 1): r"[0-9A-Fa-f]:[0-9A-Fa-f:]",
         ("card", 0): r"[0-9][\x20-]?[0-9]", ("card", 1): r"[0-9]{4}[./_\x20]", ("phone", 0): r"\+[0-9]", ("phone", 1): r"[0-9]{3}"}
#: Words that speak for a kind just before or after it, and words that speak against any.
CUES = {"email": "e-?mail|mail|contact|write|reach|address", "ip": r"\bip\b|ipv[46]|host|server|address|login",
        "card": "card|visa|credit|debit|amex|account|payment", "phone": "phone|tel|call|mobile|cell|fax|dial|ring"}
AGAINST = r"version|release|isbn|invoice|order|section|chapter|serial|item|ratio|score|page|\bref\b|\bid\b|\bat the\b"
#: Code points of context on each side.
CONTEXT = 32
FEATURES = ("kind", "loose", "cue", "against", "digits", "parts", "marked", "checked", "glued")
#: Trees, their learning rate, and the share of right labels a threshold needs.
TREES, RATE, PRECISION = 40, 0.3, 0.98
#: Weight of a written example, and of all strict candidates of a corpus together, so that its size changes nothing.
WRITTEN_WEIGHT, CORPUS_WEIGHT = 5.0, 200.0

#: (kind, text, right): candidates in context, for the looser forms above all; spans are found by the generators.
WRITTEN = (
    ("email", "please email anna.lee (at) mail (dot) org today", 1), ("email", "contact me: joe [at] example [dot] com", 1), ("email", "write to kim {at} site {dot} net", 1),
    ("email", "reach her by mail sam at example dot com now", 1), ("email", "e-mail bob42 @ example.com for more", 1), ("email", "look at the site. More", 0),
    ("email", "we met at noon. Then", 0), ("email", "arrived at home. And then", 0), ("email", "it was sold at market. The rest", 0), ("email", "tickets at example.com are free", 0),
    ("ip", "server ip 2001:0db8:0000:0000:0000:ff00:0042:8329 is down", 1), ("ip", "login from host fe80:0:0:0:202:b3ff:fe1e:8329 at night", 1),
    ("ip", "gateway address 2001:db8::1 answers", 1), ("ip", "the ip fe80::1 of the host", 1), ("ip", "login from 2a02:8070:61::8329 today", 1), ("ip", "host 2001:db8:: is ours", 1),
    ("ip", "blocked 2001:db8:85a3::8a2e:370:7334 again", 1), ("ip", "seen at 2a00:1450:4001:82b::200e twice", 1), ("ip", "the ratio 3::4 of the score", 0), ("ip", "section a::b of the page", 0),
    ("ip", "it was 10::20 then", 0), ("ip", "the class c::d has", 0), ("ip", "item 7:: the next", 0), ("ip", "ratio 1:2:3:4:5:6:7:8 in the score", 0), ("ip", "release version 1:0:0:0:0:0:0:1 notes", 0),
    ("card", "credit card 4111.1111.1111.1111 expires", 1), ("card", "visa 4012 - 8888 - 8888 - 1881 payment", 1), ("card", "card 5500_0000_0000_0004 charged", 1),
    ("card", "order 2020/2021/2022/2023 section", 0), ("card", "invoice 1000.2000.3000.4000 total", 0), ("card", "page 1999/2000/2001/2002 of", 0),
    ("phone", "call (415) 555-2671 now", 1), ("phone", "tel 020 7946 0958 office", 1), ("phone", "phone: 415-555-0199 or", 1), ("phone", "fax 0171/555 1234 thanks", 1),
    ("phone", "mobile 0151 555 1234 please", 1), ("phone", "isbn 978-0306-4061 print", 0), ("phone", "order 100-2000-3000 shipped", 0), ("phone", "version 123.456.789 notes", 0),
    ("phone", "between 100 2000 3000 items", 0), ("phone", "score 123-456-789 in", 0), ("phone", "the numbers 345 678 901 are", 0),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others; the argument holds digits only."""
    each = F.split(F.reverse(digits), "(?!^)(?=.)")
    return F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int")))),
                       F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, body: Column) -> Column:
    """The check of a strict form."""
    digits = _digits(body)
    n = F.char_length(digits)
    octets = F.forall(F.split(body, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(body, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    return (F.when(kind == "email", True).when(kind == "ip", octets)
            .when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(False)).otherwise(n.between(9, 15)))


def candidates(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per candidate: keys, kind, loose (0 or 1), start, end (code points, end exclusive), body, before, after.

    `keys` name a text; equal texts are searched once each time and collapse here.
    """
    found = []
    for loose, forms in enumerate((STRICT, LOOSE)):
        for kind in KINDS:
            own = docs.filter(F.col(text).rlike(NEEDS[kind, loose])).select(*keys, F.regexp_extract_all(F.col(text), F.lit(forms[kind]), F.lit(0)).alias("_m"), F.col(text).alias("_text"))
            own = own.filter(F.size("_m") > 0).select(*keys, F.posexplode(F.arrays_zip(F.col("_m").alias("body"), F.split("_text", forms[kind], -1).alias("gap"))).alias("at", "x"))
            found.append(own.select(*keys, F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), "at", F.col("x.body").alias("body"),
                                    F.char_length("x.gap").cast("long").alias("gap"), F.right("x.gap", F.lit(CONTEXT)).alias("before"), F.left("x.gap", F.lit(CONTEXT)).alias("head")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.dropDuplicates([*keys, "kind", "loose", "at"])
    order = Window.partitionBy(*keys, "kind", "loose").orderBy("at")
    size = F.coalesce(F.char_length("body"), F.lit(0))
    placed = rows.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("after", F.lead("head").over(order))
    return (placed.filter(F.col("body").isNotNull())  # the gap after the last match has none
            .select(*keys, "kind", "loose", (F.col("end") - size).alias("start"), "end", "body", "before", F.coalesce("after", F.lit("")).alias("after")))


def described(rows: DataFrame) -> DataFrame:
    """Candidates with `passed` (strict forms: the check) and FEATURES, each one of a few whole numbers."""
    body, around = F.col("body"), F.lower(F.concat_ws(" | ", "before", "after"))
    cue = F.lit(False)
    for kind in KINDS:
        cue = F.when(F.col("kind") == kind, around.rlike(CUES[kind])).otherwise(cue)
    n = F.char_length(_digits(body))
    digits = F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 16, 3).when(n < 20, 4).otherwise(5)
    parts = F.least(F.size(F.split(body, "[^A-Za-z0-9]+")), F.lit(6))
    glued = F.col("before").rlike(r"[A-Za-z0-9_=/:#.-]$") | F.col("after").rlike(r"^[A-Za-z0-9_=/:#-]")
    marked = F.when(body.rlike(r"[(\[{](?:at|dot)[)\]}]|\x20dot\x20"), 2).when(body.rlike(r"\(|\x20@\x20|[A-Fa-f]"), 1).otherwise(0)
    checked = F.when((F.col("kind") == "card") & n.between(13, 19), luhn(_digits(body))).otherwise(False)
    passed = F.when(F.col("loose") == 0, passes(F.col("kind"), body)).otherwise(F.lit(None).cast("boolean"))
    return (rows.withColumn("passed", passed).withColumn("_kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
            .select(*rows.columns, "passed", F.col("_kind").alias("f_kind"), F.col("loose").cast("int").alias("f_loose"), cue.cast("int").alias("f_cue"),
                    around.rlike(AGAINST).cast("int").alias("f_against"), digits.cast("int").alias("f_digits"), parts.cast("int").alias("f_parts"),
                    marked.cast("int").alias("f_marked"), checked.cast("int").alias("f_checked"), glued.cast("int").alias("f_glued")))


@dataclass
class Model:
    """Depth-two trees: (feature, value) splits by equality, leaves for no/no, no/yes, yes/no, yes/yes."""
    trees: list[tuple[tuple[str, int], tuple[str, int], tuple[float, float, float, float]]] = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def value(self, cell: dict[str, int]) -> float:
        return self.start + sum(leaf[2 * (cell[f] == v) + (cell[g] == w)] for (f, v), (g, w), leaf in self.trees)

    def column(self) -> Column:
        total = F.lit(self.start)
        for (f, v), (g, w), leaf in self.trees:
            yes = F.col(f"f_{g}") == w
            total = total + F.when(F.col(f"f_{f}") == v, F.when(yes, leaf[3]).otherwise(leaf[2])).otherwise(F.when(yes, leaf[1]).otherwise(leaf[0]))
        return 1 / (1 + F.exp(-total))

    def accepts(self) -> Column:
        least = F.lit(2.0)
        for kind in KINDS:
            least = F.when(F.col("kind") == kind, self.thresholds.get(kind, 2.0)).otherwise(least)
        return self.column() >= least


def boost(cells: list[tuple[dict[str, int], float, float]]) -> Model:
    """Trees on (cell, weight of right labels, weight of wrong ones); logistic loss, Newton leaves."""
    model = Model()
    right, wrong = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not cells or not right or not wrong:
        return model
    model.start = math.log(right / wrong)
    values = [model.start] * len(cells)
    splits = [(f, v) for f in FEATURES for v in sorted({c[0][f] for c in cells})]
    for _ in range(TREES):
        chance = [1 / (1 + math.exp(-z)) for z in values]
        slope = [c[1] * (1 - p) - c[2] * p for c, p in zip(cells, chance, strict=True)]
        curve = [(c[1] + c[2]) * p * (1 - p) for c, p in zip(cells, chance, strict=True)]
        best = None
        for (f, v), (g, w) in itertools.combinations(splits, 2):
            if f == g:
                continue
            sums = [[0.0, 1.0] for _ in range(4)]  # one is the ridge
            for (cell, _, _), s, h in zip(cells, slope, curve, strict=True):
                leaf = sums[2 * (cell[f] == v) + (cell[g] == w)]
                leaf[0] += s
                leaf[1] += h
            gain = sum(s * s / h for s, h in sums)
            if best is None or gain > best[0] + 1e-12:
                best = gain, (f, v), (g, w), tuple(RATE * s / h for s, h in sums)
        if best is None:
            break
        model.trees.append(best[1:])
        values = [z + best[3][2 * (c[0][best[1][0]] == best[1][1]) + (c[0][best[2][0]] == best[2][1])] for z, c in zip(values, cells, strict=True)]
    for k, kind in enumerate(KINDS, 1):
        # strict spans stay whatever the threshold, so only the looser ones set it
        own = sorted(((1 / (1 + math.exp(-model.value(c))), a, b) for c, a, b in cells if c["kind"] == k and c["loose"]), reverse=True)
        good = bad = 0.0
        least = 2.0
        for p, a, b in own:
            good, bad = good + a, bad + b
            if p >= 0.5 and good >= PRECISION * (good + bad):
                least = p - 1e-9
        model.thresholds[kind] = least
    return model


def cells_of(rows: DataFrame, right: Column) -> list[tuple[dict[str, int], int, int]]:
    """Counts of right and wrong labels per combination of features; there are a few thousand combinations at most."""
    found = (rows.withColumn("_right", right).filter(F.col("_right").isNotNull()).groupBy(*[f"f_{f}" for f in FEATURES])
             .agg(F.sum(F.col("_right").cast("int")).alias("a"), F.sum((~F.col("_right")).cast("int")).alias("b")).collect())
    return sorted(((({f: r[f"f_{f}"] for f in FEATURES}), r["a"], r["b"]) for r in found), key=str)


def train(spark: SparkSession, rows: DataFrame) -> Model:
    """A model from described candidates of the corpus and the written table.

    Counts of the corpus enter by their square root and add up to a fixed weight, so that a corpus of
    any size leaves the written table its say and its size alone moves no threshold.
    """
    written = spark.createDataFrame([(i, k, t, bool(y)) for i, (k, t, y) in enumerate(WRITTEN)], "n long, want string, text string, right boolean")
    known = described(candidates(written, "text", ["n"])).join(written.select("n", "want", "right"), "n").filter("kind = want AND loose = 1")
    cells = [(c, WRITTEN_WEIGHT * a, WRITTEN_WEIGHT * b) for c, a, b in cells_of(known, F.col("right"))]
    strict = [(c, math.sqrt(a), math.sqrt(b)) for c, a, b in cells_of(rows, F.col("passed"))]
    share = CORPUS_WEIGHT / max(sum(a + b for _, a, b in strict), 1.0)
    return boost(cells + [(c, share * a, share * b) for c, a, b in strict])


def accepted(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Rows (keys, spans): per text its spans (kind, start, end, base), base spans and accepted loose ones.

    A loose span that overlaps a base span goes; of those left that overlap each other the leftmost
    stays, of two that start together the longer one. A dropped span drops no other.
    """
    kept = rows.filter((F.col("loose") == 0) & F.col("passed") | (F.col("loose") == 1) & model.accepts()).select(*keys, "kind", "loose", "start", "end")
    # a loose span must begin after all strict ends before it and end before the next strict start
    order = Window.partitionBy(*keys).orderBy("start", "loose", F.col("end").desc(), "kind")
    ends = F.max(F.when(F.col("loose") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    strict_next = F.min(F.when(F.col("loose") == 0, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = kept.withColumn("_e", ends).withColumn("_n", strict_next).filter(
        (F.col("loose") == 0) | (F.coalesce(F.col("_e") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_n") >= F.col("end"), F.lit(True))))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind", (F.col("loose") == 0).alias("base"))
    # loose spans of a text from left to right; only texts in which some overlap are walked
    last = F.max(F.when(F.col("loose") == 1, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    meets = (F.col("loose") == 1) & F.coalesce(last > F.col("start"), F.lit(False))
    placed = free.select(*keys, "loose", span.alias("span"), F.struct("start", (-F.col("end")).alias("to"), span.alias("span")).alias("at"), meets.alias("meets"))
    each = placed.groupBy(*keys).agg(F.collect_list(F.when(F.col("loose") == 0, F.col("span"))).alias("strict"), F.sort_array(F.collect_list(F.when(F.col("loose") == 1, F.col("at")))).alias("loose"), F.max("meets").alias("meets"))
    own = F.transform("loose", lambda x: x["span"])
    walk = F.aggregate(own, F.array().cast(each.schema["strict"].dataType), lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]), done).otherwise(F.concat(done, F.array(s))))
    return each.select(*keys, F.sort_array(F.concat("strict", F.when(F.col("meets"), walk).otherwise(own))).alias("spans"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `_spans`, an array of (rank, start, end, kind, base) sorted by kind as listed, then start.

    Starts and ends are code points, ends exclusive. A null or empty text has no spans; every row comes
    back, repeated rows too, and equal texts get equal spans. An empty table gives an empty table. Other
    columns may have any names except _spans.
    """
    return _with_spans(docs, text).select(*restored(docs.columns, text), "_spans")


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """`docs` set aside as _row and _text, plus _spans."""
    keyed = aside(docs, text)
    keyed = keyed.select("*", *row_key("_text"))
    keys = ["_k1", "_k2"]
    rows = stage(described(candidates(keyed, "_text", keys)), "candidates")
    model = train(docs.sparkSession, rows)
    spans = stage(accepted(rows, keys, model), "spans")
    empty = F.array().cast(spans.schema["spans"].dataType)
    return keyed.join(spans, keys, "left").select("_row", "_text", F.coalesce("spans", empty).alias("_spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in angle brackets; overlapping spans give one mark, of the first. Columns may have any names."""
    found = _with_spans(docs, text)
    by_place = F.sort_array(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged = F.aggregate(by_place, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"),
                         lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
                                                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"), F.element_at(done, -1)["kind"].alias("kind")))))
                         .otherwise(F.concat(done, F.array(s))))
    step = found.withColumn("_done", F.when(F.size("_spans") > 0, merged))
    zipped = F.arrays_zip(F.col("_done").alias("own"), F.concat(F.array(F.lit(0).cast("long")), F.transform("_done", lambda s: s["end"])).alias("last"))
    pieces = F.transform(zipped, lambda z: F.when(z["own"].isNull(), F.substring("_text", (z["last"] + 1).cast("int"), F.lit(2**31 - 1)))
                         .otherwise(F.concat(F.substring("_text", (z["last"] + 1).cast("int"), (z["own"]["start"] - z["last"]).cast("int")), F.lit("<"), F.upper(z["own"]["kind"]), F.lit(">"))))
    return step.select("_row", F.when(F.col("_done").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("_text")).alias("_text")).select(*restored(docs.columns, text))


@query("op1_pii")
def op1_pii(spark, sf_dir):
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_spans", lambda s: s["base"])
    named = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(named, F.lit(kind))) for kind in KINDS]
    counts = [(F.size(base) - rest).cast("long").alias(f"n_{kind}") for kind, rest in zip(KINDS, counts, strict=True)]
    return out.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("_spans")).alias("spans"))
