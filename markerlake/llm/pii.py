"""Personal data by candidate gradient boosting (operator 9), in DataFrame functions only.

Generators with high recall propose spans, which may overlap: the four base kinds by their patterns, and telephone
numbers without a plus, mail addresses in disguise, social security numbers, bank accounts and secrets. Boosted trees
over format and context features estimate how likely a candidate is personal. They learn from what can be told without
them: base candidates by whether they pass their kind's check, the others by what announces them (`tel:`, `token =`) or
says that they are something else (`version`, `sha1`); from the rest they don't learn. Trees are fitted on counts of feature values in one half of the documents, and each kind's threshold
is the least with enough precision in the other half. Base spans that pass their check always stay. Another candidate is
added if the model puts it above its kind's threshold, it doesn't fail a check, and no base span and no likelier
candidate overlaps it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch

#: Kinds in the order in which spans are listed. The first four are the base.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
TREES, RATE, LEAST_CHILD = 24, 0.3, 5.0
PRECISION = 0.9  # share of valid candidates, in the half that calibrates, from which on a threshold is taken
CONTEXT = 32  # characters before and after a candidate that are looked at
NEAR = 24  # candidates before and after one, in order of their starts, that can overlap it if none is LONG
LONG = 96  # characters


@dataclass(frozen=True)
class Generator:
    kind: str
    base: bool
    pattern: str
    likely: str  # a cheap test that every text with a match passes


#: Possessive quantifiers and look-behinds find what the plain patterns find, in time linear in the text.
GENERATORS = (
    Generator("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    Generator("card", True, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    Generator("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Generator("phone", False, r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Generator("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\((?i:at)\)|\[(?i:at)\]|\{(?i:at)\}|\x20(?i:at)\x20(?=[A-Za-z0-9-]{1,63}\x20(?i:dot)\x20))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\((?i:dot)\)|\[(?i:dot)\]|\{(?i:dot)\}|\x20(?i:dot)\x20|\.)\x20?[A-Za-z]{2,24}){1,4}", r"(?i)[\[({]at[\])}]|\x20dot\x20"),
    Generator("ssn", False, r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    Generator("iban", False, r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    Generator("secret", False, r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z_+/-]{0,64}[0-9])(?=[0-9_+/-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9@.])", r"[A-Za-z0-9+/_-]{20}"),
)
#: Words near a candidate that go with personal data, and words just before one that say what else it is.
HINTS = r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|mail|e-mail|contact|write|reach|ssn|social|card|visa|account|iban|ip|address|server|host|token|secret|password|passwd|pwd|key|credential|auth)\b"
OTHER = r"(?i)\b(?:version|ver|build|release|rev|commit|hash|sha1|sha256|md5|checksum|digest|uuid|doi|isbn|order|item|part|serial|invoice|ticket|page|fig|section|chapter|id|ref|no)\b[\s:=#.\"'(]{0,4}$"
#: What announces a candidate that isn't of the base.
ANNOUNCED = {
    "ssn": r"(?i)\b(?:ssn|social security(?: number)?)\b[\s:.#]{0,3}$",
    "iban": r"(?i)\b(?:iban|account)\b[\s:.#]{0,3}$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax)\b[\s:.#]{0,3}$",
    "email": r"(?i)\b(?:mail|e-mail|contact|write|reach)\b[\w\s:]{0,12}$",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|key|credential|auth)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$",
}
FEATURES = ("kind", "digits", "size", "marks", "before", "after", "hint", "other", "crowd")
#: What is known before any table is seen, as counts: kind, digits, size, marks of a usual candidate; of how many each
#: are valid where hints are near, where nothing is, and where something else is named. They stand for PRIOR candidates.
PRIOR = 8.0
USUAL = (("phone", 10, 3, 2, 0.95, 0.7, 0.1), ("email", 0, 5, 4, 0.95, 0.85, 0.2), ("ssn", 9, 2, 2, 0.98, 0.85, 0.1), ("iban", 18, 5, 4, 0.98, 0.9, 0.3), ("secret", 20, 10, 0, 0.95, 0.3, 0.02))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number passes its check: country and check digits last, letters as numbers from 10 up."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def passes(kind: str, base: bool, match: Column) -> Column:
    digits = digits_of(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15) if base else ~F.substring(digits, 1, 1).isin("0", "1")
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def proposed(text: Column, g: Generator) -> Column:
    """Array of a generator's candidates: kind (place in KINDS), base, s, e (code points, end exclusive), ok (doesn't fail
    its kind's check), told (whether it is known to be valid; null if nothing tells), features.

    What lies between matches is split off, so that places are sums of lengths.
    """
    found = F.when(text.rlike(g.likely) if g.likely != "@" else text.contains("@"), F.struct(F.regexp_extract_all(text, F.lit(g.pattern), 0).alias("m"), F.split(text, g.pattern, -1).alias("gap")))
    kind = KINDS.index(g.kind)

    def ends(x: Column) -> Column:
        """Where each match ends: sums within runs of 64 matches, and of whole runs, so that long arrays aren't copied."""
        sizes = F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: F.length(F.get(x["gap"], i)) + F.length(F.get(x["m"], i)))

        def sums(some: Column) -> Column:
            return F.aggregate(some, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n)))

        def joined(parts: Column) -> Column:
            before = sums(F.transform(parts, lambda part: F.get(part, F.size(part) - 1)))
            return F.flatten(F.flatten(F.transform(F.array(before), lambda b: F.transform(parts, lambda part, j: F.transform(part, lambda n: n + F.coalesce(F.get(b, j - 1), F.lit(0)))))))

        runs = F.transform(F.array(sizes), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / 64).cast("int")), lambda j: sums(F.slice(all_, j * 64 + 1, F.lit(64)))))
        return F.flatten(F.transform(runs, joined))

    def side(char: Column) -> Column:
        return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[A-Za-z0-9]"), 3).otherwise(2)

    def candidate(x: Column, stop: Column, i: Column) -> Column:
        match, before, after = F.get(x["m"], i), F.get(x["gap"], i), F.get(x["gap"], i + 1)
        left, right = F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))
        digits, size = F.length(digits_of(match)), F.length(match)
        features = {
            "kind": F.lit(kind if g.base else kind + len(KINDS)),
            "digits": F.least(digits, F.lit(20)),
            "size": F.least(F.floor(size / 4).cast("int"), F.lit(10)),
            "marks": F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(6)),
            "before": side(F.right(before, F.lit(1))),
            "after": side(F.left(after, F.lit(1))),
            "hint": (left.rlike(HINTS) | right.rlike(HINTS)).cast("int"),
            "other": left.rlike(OTHER).cast("int"),
            "crowd": (left.rlike(r"[0-9][\s,;|]{0,3}$") | right.rlike(r"^[\s,;|]{0,3}[0-9]")).cast("int"),
        }
        end, ok = F.get(stop, i), passes(g.kind, g.base, match)
        told = ok if g.base else F.when(ok & left.rlike(ANNOUNCED[g.kind]), True).when(ok & left.rlike(OTHER), False)
        return F.struct(F.lit(kind).alias("k"), F.lit(g.base).alias("base"), (end - size).alias("s"), end.alias("e"), ok.alias("ok"), told.alias("told"), *(v.cast("int").alias(n) for n, v in features.items()))

    shape = "array<struct<k:int,base:boolean,s:int,e:int,ok:boolean,told:boolean," + ",".join(f"{n}:int" for n in FEATURES) + ">>"
    # one-element arrays carry the matches and their ends into the lambdas, so that they are made once
    some = F.filter(F.array(found), lambda x: F.size(x["m"]) > 0)
    each = F.flatten(F.flatten(F.transform(some, lambda x: F.transform(F.array(ends(x)), lambda stop: F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: candidate(x, stop, i))))))
    return each.cast(shape)


def candidates(documents: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """doc_id, columns to keep (new names and old), and all candidates of every row's whole text."""
    keep = keep or {}
    kept = [documents[f"`{old}`"].alias(new) for new, old in keep.items()]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for i, g in enumerate(GENERATORS):
        rows = rows.withColumn(f"_c{i}", proposed(F.col("_text"), g))
    return rows.select("doc_id", *keep, F.concat(*(F.col(f"_c{i}") for i in range(len(GENERATORS)))).alias("candidates"))


# -- boosted trees over counted feature values ---------------------------------------------------------------------------
Row = tuple[tuple[int, ...], float, float]  # feature values, how many candidates, how many of them valid
Tree = tuple | float  # (feature, value: at most, low, high) or a leaf


def grow(rows: list[Row], scores: dict[tuple[int, ...], float], depth: int) -> Tree:
    """A tree of least squares on the gradient of the logistic loss, in one walk over the rows for each node's feature."""
    each = []
    for x, n, valid in rows:
        p = 1 / (1 + math.exp(-scores[x]))
        each.append((x, valid - n * p, n * p * (1 - p), n))
    g, h, total = (sum(r[i] for r in each) for i in (1, 2, 3))
    best = (1e-6, -1, 0)
    for f in range(len(FEATURES) if depth else 0):
        by: dict[int, list[float]] = {}
        for x, *sums in each:
            own = by.setdefault(x[f], [0.0, 0.0, 0.0])
            for i, v in enumerate(sums):
                own[i] += v
        gl = hl = nl = 0.0
        for value in sorted(by)[:-1]:
            gl, hl, nl = gl + by[value][0], hl + by[value][1], nl + by[value][2]
            if min(nl, total - nl) >= LEAST_CHILD:
                best = max(best, (gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1), f, value))
    if best[1] < 0:
        return RATE * g / (h + 1)
    _, f, value = best
    return (f, value, grow([r for r in rows if r[0][f] <= value], scores, depth - 1), grow([r for r in rows if r[0][f] > value], scores, depth - 1))


def value_of(tree: Tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(rows: list[Row]) -> list[Tree]:
    total, valid = sum(n for _, n, _ in rows), sum(v for _, _, v in rows)
    start = math.log((valid + 1) / (total - valid + 1))
    scores, trees = {x: start for x, _, _ in rows}, [start]
    for _ in range(TREES if rows else 0):
        tree = grow(rows, scores, 3)
        trees.append(tree)
        for x in scores:
            scores[x] += value_of(tree, x)
    return trees


@dataclass
class Model:
    trees: list[Tree]
    thresholds: list[float]  # least log-odds of each kind


def known_before() -> list[Row]:
    """USUAL as rows of feature values: hint, nothing, something else named."""
    out = []
    for kind, digits, size, marks, *shares in USUAL:
        for share, hint, other in zip(shares, (1, 0, 0), (0, 0, 1), strict=True):
            out.append(((KINDS.index(kind) + len(KINDS), digits, size, marks, 1, 1, hint, other, 0), PRIOR, PRIOR * share))
    return out


def train(found: DataFrame) -> Model:
    """Trees and thresholds from all candidates of which something tells whether they are valid.

    The number of combinations of feature values is bounded, and so is what comes to the driver. A kind of which the
    calibrating half tells nothing has the threshold 0: as likely as not.
    """
    half = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2, F.lit(0)).alias("half")
    each = found.select(half, F.explode("candidates").alias("c")).where("c.told is not null")
    counted = each.groupBy("half", *(F.col(f"c.{x}").alias(x) for x in FEATURES)).agg(F.count("*").alias("n"), F.count(F.when(F.col("c.told"), 1)).alias("valid"))
    rows = sorted((r["half"], tuple(r[x] for x in FEATURES), float(r["n"]), float(r["valid"])) for r in counted.collect())
    merged: dict[tuple[int, ...], list[float]] = {}
    for x, n, valid in [*(r[1:] for r in rows if r[0] == 0), *known_before()]:
        own = merged.setdefault(x, [0.0, 0.0])
        own[0], own[1] = own[0] + n, own[1] + valid
    trees = boost([(x, n, v) for x, (n, v) in sorted(merged.items())])
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((reduce(lambda a, t: a + value_of(t, x), trees, 0.0), n, v) for half, x, n, v in rows if half == 1 and x[0] == kind + len(KINDS)), reverse=True)
        thresholds.append(threshold(own))
    return Model(trees, thresholds)


def threshold(scored: list[tuple[float, float, float]]) -> float:
    """The least score, 0 at least, from which on enough of the candidates (score, how many, how many valid) are valid."""
    n = valid = 0.0
    line = scored[0][0] + 1.0 if scored else 0.0  # where not even the likeliest are valid often enough, none is taken
    for i, (score, more, good) in enumerate(scored):
        n, valid, last = n + more, valid + good, i + 1 == len(scored)
        if (last or scored[i + 1][0] < score) and valid >= PRECISION * n:
            line = 0.0 if last else score  # where nothing speaks against the last, nor against what lies between it and 0
    return max(0.0, line)


def log_odds(model: Model, c: Column) -> Column:
    def column(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, value, low, high = tree
        return F.when(c[FEATURES[f]] <= value, column(low)).otherwise(column(high))

    return reduce(lambda a, b: a + b, map(column, model.trees))


def chosen(model: Model) -> tuple[Column, Column]:
    """Base spans and all spans, as sorted arrays of (k, s, e), from the column `candidates`."""
    line = F.array(*map(F.lit, model.thresholds))
    usable = F.filter("candidates", lambda c: c["ok"])
    # base spans come with an endless score, so that nothing that overlaps one stays
    scored = F.transform(usable, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), c["base"].alias("base"), F.when(c["base"], F.lit(math.inf)).otherwise(log_odds(model, c) - F.get(line, c["k"])).alias("above")))
    ordered = F.array_sort(F.filter(scored, lambda c: c["above"] >= 0))

    def better(c: Column, some: Column) -> Column:
        """Whether one of the others overlaps c and goes before it: by its score, then its place."""
        return F.exists(some, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]) & ((o["above"] > c["above"]) | ((o["above"] == c["above"]) & ((o["s"] < c["s"]) | ((o["s"] == c["s"]) & (o["k"] < c["k"]))))))

    def left(all_: Column) -> Column:
        near = F.filter(all_, lambda c, i: c["base"] | ~better(c, F.slice(all_, F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))))
        return F.when(F.exists(all_, lambda c: c["e"] - c["s"] > LONG), F.filter(all_, lambda c: c["base"] | ~better(c, all_))).otherwise(near)

    every = F.flatten(F.transform(F.array(ordered), left))

    def plain(x: Column) -> Column:
        return F.array_sort(F.transform(x, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))))

    return plain(F.filter(usable, lambda c: c["base"])), plain(every)


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row's whole text.

    Spans are kind:start:end, by kind in the order of KINDS and then start, joined by commas; base_sha256 is that of the
    base spans. Null and empty texts have no spans; null ids stay null; repeated rows are searched each.
    """
    scratch = Scratch(documents.sparkSession, "pii")
    found = scratch.keep(candidates(documents))
    base, every = chosen(train(found))
    rows = found.select("doc_id", base.alias("base"), every.alias("every"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return scratch.result(rows.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("every")).alias("spans")))


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns with each span of `text` replaced by its kind, such as [EMAIL]; n_chars follows if there.

    Spans that overlap are replaced together by the first one's kind. Null texts stay null.
    """
    model = train(candidates(documents))
    columns = documents.columns
    rows = candidates(documents, {f"_keep_{i}": x for i, x in enumerate(columns)})
    _, every = chosen(model)
    rows = rows.withColumn("_spans", F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))))
    text = F.col(f"_keep_{columns.index('text')}").cast("string")
    names = F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,n:int,k:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (x["s"] - a["at"]).alias("n"), x["k"].alias("k"))))
        return F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), more.alias("out")))

    def joined(a: Column) -> Column:
        kept = F.transform(a["out"], lambda x: F.concat(F.substring(text, x["s"] + 1, x["n"]), F.get(names, x["k"])))
        return F.concat(F.array_join(kept, ""), F.substring(text, a["at"] + 1, F.length(text)))

    done = F.aggregate("_spans", start, step, joined)
    rows = rows.withColumn("_new", F.when(F.size("_spans") > 0, done).otherwise(text))
    return rows.select(*(F.col("_new").alias(x) if x == "text" else F.length("_new").cast("long").alias(x) if x == "n_chars" else F.col(f"_keep_{i}").alias(x) for i, x in enumerate(columns)))
