"""Personal data: generated candidate spans, boosted trees over format and context, calibrated thresholds; in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reposift.llm.common import staged

# The base patterns in linear-time form.  A pattern that begins with a run of a class can only match from
# where the run begins, or where the match before ended (\G); possessive quantifiers stop retries that can't succeed.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))" + EMAIL,
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GUARD = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "handle": "@", "number": "[0-9]", "secret": "[0-9]"}
#: Own generators of high recall: anything around an at sign, grouped digits, long mixes of letters and digits.
LOOSE = {
    "handle": r"(?<![^\s<>(),;:\"'])[^\s<>(),;:\"'@]++@[^\s<>(),;:\"'@]++",
    "number": r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
}
KINDS = [*BASE, *LOOSE]
BEFORE, AFTER = 24, 12
CUE = r"(?i)(?:token|secret|passw(?:or)?d|pwd|credential|api[_-]?key|\bkey)\s*['\"]?\s*[:=]\s*['\"]?$"
FEATURES = [
    "digits", "letters", "upper", "chars", "groups", "turns", "dots", "dashes", "spaces", "brackets", "at", "plus", "hex",
    "card_like", "phone_like", "id_like", "address_like", "quoted", "assigned", "word_before", "word_after",
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of an array's values, by doubling the reach: n log n steps in all."""
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")),
                        lambda b: F.call_function("shiftleft", F.lit(1), b))
    return F.aggregate(reach, values, lambda sums, step: F.transform(
        sums, lambda x, i: F.when(i >= step, combine(x, F.get(sums, i - step))).otherwise(x)))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern as (kind, start, end, found, before, after); places are code points."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>")
    found = F.when(text.rlike(GUARD[kind]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def told(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            ends = running(F.transform(matches, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m)), lambda a, b: a + b)
            return _let(ends, lambda to: F.transform(matches, lambda m, i: F.struct(
                F.lit(kind).alias("kind"), (F.get(to, i) - F.char_length(m)).alias("start"), F.get(to, i).alias("end"), m.alias("found"),
                F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"))))

        return F.when(F.coalesce(F.size(matches), F.lit(0)) > 0, _let(F.split(text, pattern, -1), placed)).otherwise(empty)

    return _let(found, told)


def candidates(text: Column) -> Column:
    """Overlapping candidate spans of every generator over a whole text."""
    return F.flatten(F.array(*[_matches(text, kind, pattern) for kind, pattern in (BASE | LOOSE).items()]))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.char_length(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _let(
        F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)), lambda d: F.when((n - i) % 2 == 0, d)
        .when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return (n > 0) & (F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0)


def valid(kind: Column, found: Column) -> Column:
    """Is a match of a base pattern personal data of that kind by the base rules?"""
    digits = _digits(found)
    n = F.char_length(digits)
    parts = F.forall(F.split(found, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("bigint") <= 255, F.lit(False)))
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", parts)
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15)).otherwise(False)
    )


def features(c: Column) -> Column:
    """Format and context of a candidate as an array of numbers, in the order of FEATURES."""
    found = c["found"]
    count = lambda pattern: F.regexp_count(found, F.lit(pattern))
    digits = count("[0-9]")
    yes = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    values = [
        digits, count("[A-Za-z]"), count("[A-Z]"), F.char_length(found), count("[0-9]+"), count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        count("\\."), count("-"), count(" "), count("[()]"), count("@"), count("\\+"), count("[0-9a-f]") * 10 / F.greatest(F.char_length(found), F.lit(1)),
        yes(F.when((c["kind"] != "secret") & digits.between(12, 19), luhn(_digits(found)))),
        yes(found.rlike(r"^(?:\+[0-9]{1,3}[\x20-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        yes(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        yes(found.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$")),
        yes(c["before"].rlike("[\"'`]$")), yes(c["before"].rlike("[:=]\\s*[\"'`]?$")),
        yes(c["before"].rlike("[\\p{L}\\p{N}_]$")), yes(c["after"].rlike("^[\\p{L}\\p{N}_]")),
    ]
    return F.array(*[v.cast("double") for v in values])


def weak_label(c: Column) -> Column:
    """A label from rules the trees don't see: base rules, a word that names a secret, formats of telephones and identity numbers."""
    digits = F.char_length(_digits(c["found"]))
    return (
        F.when(c["kind"].isin(*BASE), valid(c["kind"], c["found"]))
        .when(c["kind"] == "secret", c["before"].rlike(CUE))
        .when(c["kind"] == "handle", c["found"].rlike("^" + EMAIL + "\\.?$"))
        .otherwise(F.when(digits.between(12, 19), luhn(_digits(c["found"]))).otherwise(
            c["found"].rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})$")))
    )


@dataclass(frozen=True)
class Node:
    """A split (feature, at: larger values go right) or, with no feature, a leaf."""

    value: float
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, depth: int, rate: float, least: float = 4.0) -> Node:
    total = slope.sum() ** 2 / (weight.sum() + 1)
    best = (1e-6, None)
    for feature in range(x.shape[1]) if depth and len(x) > 1 else ():
        order = np.argsort(x[:, feature], kind="stable")
        value = x[order, feature]
        g, h = np.cumsum(slope[order])[:-1], np.cumsum(weight[order])[:-1]
        cut = np.flatnonzero((value[1:] > value[:-1]) & (h * 4 > least) & ((weight.sum() - h) * 4 > least))
        if not len(cut):
            continue
        gain = g[cut] ** 2 / (h[cut] + 1) + (slope.sum() - g[cut]) ** 2 / (weight.sum() - h[cut] + 1) - total
        top = int(gain.argmax())
        if gain[top] > best[0]:
            best = (float(gain[top]), (feature, float(value[cut[top]] + value[cut[top] + 1]) / 2))
    if best[1] is None:
        return Node(float(rate * slope.sum() / (weight.sum() + 1)))
    feature, at = best[1]
    right = x[:, feature] > at
    return Node(0.0, feature, at, *(_grow(x[s], slope[s], weight[s], depth - 1, rate, least) for s in (~right, right)))


def _leaf(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] > node.at, _leaf(node.right, x), _leaf(node.left, x))


def _walk(node: Node, x: Column) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(F.get(x, F.lit(node.feature)) > F.lit(node.at), _walk(node.right, x)).otherwise(_walk(node.left, x))


@dataclass(frozen=True)
class Model:
    """Boosted trees of one generator: log odds are ``base`` plus every tree's leaf; ``threshold`` on the probability selects."""

    base: float
    trees: tuple[Node, ...]
    threshold: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_leaf(t, x) for t in self.trees), np.zeros(len(x)))

    def odds(self, x: Column) -> Column:
        """The log odds as an expression over the array of features."""
        odds = F.lit(self.base)
        for tree in self.trees:
            odds = odds + _walk(tree, x)
        return odds

    def score(self, x: Column) -> Column:
        """The probability as an expression over the array of features."""
        return 1 / (1 + F.exp(-self.odds(x)))


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.4,
        precision: float = 0.95, least: int = 5) -> Model:
    """Logistic gradient boosting on the rows outside ``fold``; the threshold is set on the rows inside.  The plain form of :func:`fit_counted`.

    It is the smallest score from which on at least ``precision`` of the fold's
    rows, and at least ``least`` of them, are positive; 2 if there is none.
    """
    own, held = ~fold, fold
    share = (y[own].sum() + 0.5) / (own.sum() + 1)
    base, trees = log(share / (1 - share)), []
    odds = np.full(own.sum(), base)
    if 0 < y[own].sum() < own.sum():
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-odds))
            trees.append(_grow(x[own], y[own] - p, p * (1 - p), depth, rate))
            odds = odds + _leaf(trees[-1], x[own])
    told = Model(base, tuple(trees), 2.0)
    scores, truth = 1 / (1 + np.exp(-told.log_odds(x[held]))), y[held]
    threshold = 2.0
    for at in np.unique(scores)[::-1]:
        chosen = truth[scores >= at]
        if chosen.mean() < precision:
            break
        if chosen.sum() >= least:
            threshold = float(at) - 1e-9
    return Model(base, tuple(trees), threshold)


def examples(found: DataFrame, seed: int = 3) -> DataFrame:
    """``kind, x, y, held, n``: all candidates of the own generators, equal ones of one half counted."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).where(F.col("c.kind").isin(*LOOSE))
    order = F.xxhash64(F.lit(seed), "doc_id", F.col("c.start"), F.col("c.found"))
    return each.select(
        F.col("c.kind").alias("kind"), features(F.col("c")).alias("x"), F.coalesce(weak_label(F.col("c")), F.lit(False)).cast("double").alias("y"),
        (order % 2 == 0).alias("held")).groupBy("kind", "x", "y", "held").agg(F.count(F.lit(1)).alias("n"))


def _by_kind(of: dict[str, Column], other: Column) -> Column:
    for kind, value in of.items():
        other = F.when(F.col("kind") == kind, value).otherwise(other)
    return other


def _best_cuts(own: DataFrame, least: float) -> list:
    """Sums and the best cut of each open node: a row per kind and node, whatever the number of examples.

    ``own(kind, node, x, slope, weight)``.  Slopes and weights are added up per
    value of each feature, then along the values.
    """
    values = own.select("kind", "node", "slope", "weight", F.posexplode("x").alias("feature", "value")).groupBy(
        "kind", "node", "feature", "value").agg(F.sum("slope").alias("slope"), F.sum("weight").alias("weight"))
    whole = Window.partitionBy("kind", "node", "feature")
    along = whole.orderBy("value")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = values.select(
        "kind", "node", "feature", ((F.col("value") + F.lead("value").over(along)) / 2).alias("at"), F.sum("slope").over(upto).alias("g"),
        F.sum("weight").over(upto).alias("h"), F.sum("slope").over(whole).alias("slope"), F.sum("weight").over(whole).alias("weight"))
    g, h, rest_g, rest_h = F.col("g"), F.col("h"), F.col("slope") - F.col("g"), F.col("weight") - F.col("h")
    gain = g * g / (h + 1) + rest_g * rest_g / (rest_h + 1) - F.col("slope") * F.col("slope") / (F.col("weight") + 1)
    allowed = F.col("at").isNotNull() & (h * 4 > least) & (rest_h * 4 > least) & (gain > 1e-6)
    # rounded, so that the order of summation doesn't choose among equal gains
    rank = F.when(allowed, F.struct(F.round(gain, 6), -F.col("feature"), -F.col("at")))
    return cuts.groupBy("kind", "node").agg(
        F.max("slope").alias("slope"), F.max("weight").alias("weight"), F.max_by(F.struct("feature", "at", "g", "h"), rank).alias("cut")).collect()


def _grow_trees(own: DataFrame, kinds: Sequence[str], depth: int, rate: float, least: float) -> dict[str, Node]:
    """The next tree of each kind, all kinds level by level in one job each; ``own(kind, x, y, n, odds)``."""
    sloped = own.withColumn("p", 1 / (1 + F.exp(-F.col("odds")))).select(
        "kind", "x", (F.col("n") * (F.col("y") - F.col("p"))).alias("slope"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("weight"))
    # places of nodes: the root is 1, below k lie 2k and 2k + 1
    cut: dict[str, dict[int, tuple[int, float]]] = {k: {} for k in kinds}
    leaf: dict[str, dict[int, float]] = {k: {1: 0.0} for k in kinds}
    opened = {k: {1} for k in kinds}

    def tree(kind: str, value: Callable[[int], float], place: int = 1) -> Node:
        if place not in cut[kind]:
            return Node(value(place))
        feature, at = cut[kind][place]
        return Node(0.0, feature, at, tree(kind, value, 2 * place), tree(kind, value, 2 * place + 1))

    for _ in range(depth):
        at = {k: _walk(tree(k, float), F.col("x")).cast("int") for k in kinds if opened[k]}
        if not at:
            break
        wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("node")) for k in at for i in sorted(opened[k])])
        level = sloped.withColumn("node", _by_kind(at, F.lit(0))).where(F.array_contains(wanted, F.struct("kind", "node")))
        opened = {k: set() for k in kinds}
        for r in _best_cuts(level, least):
            kind, node = r["kind"], r["node"]
            leaf[kind][node] = rate * r["slope"] / (r["weight"] + 1)
            if r["cut"] is not None:
                feature, middle, g, h = r["cut"]
                cut[kind][node] = (feature, middle)
                for place, slope, weight in ((2 * node, g, h), (2 * node + 1, r["slope"] - g, r["weight"] - h)):
                    leaf[kind][place] = rate * slope / (weight + 1)
                    opened[kind].add(place)
    return {k: tree(k, lambda place, k=k: float(leaf[k][place])) for k in kinds}


#: Scores are told apart by this part when the threshold is sought, so its search orders no more rows than that.
SCORE_STEPS = 1_000_000


def fit_counted(rows: DataFrame, rounds: int = 12, depth: int = 3, rate: float = 0.4, precision: float = 0.95, least: int = 5) -> dict[str, Model]:
    """What :func:`fit` does, for each kind, on counted examples ``kind, x, y, held, n`` of any number; Spark forms all sums.

    Only sums and cuts of tree nodes reach the driver, at most 2^depth a kind.
    """
    x, n = F.col("x"), F.col("n")
    half = {r["kind"]: (r["n"], r["y"]) for r in rows.where(~F.col("held")).groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("y")).alias("y")).collect()}
    models = {}
    for kind in LOOSE:
        many, positive = half.get(kind, (0, 0.0))
        share = (positive + 0.5) / (many + 1)
        models[kind] = Model(log(share / (1 - share)), (), 2.0)
    mixed = [k for k, (many, positive) in half.items() if 0 < positive < many]
    # the odds so far stand in the rows, so the plan of a level holds one tree only
    own = rows.where(~F.col("held") & F.col("kind").isin(mixed)).select(
        "kind", "x", "y", "n", _by_kind({k: F.lit(models[k].base) for k in mixed}, F.lit(0.0)).alias("odds"))
    for i in range(rounds if mixed else 0):
        trees = _grow_trees(own, mixed, depth, rate, 4.0)
        for kind, tree in trees.items():
            models[kind] = Model(models[kind].base, (*models[kind].trees, tree), 2.0)
        if i + 1 < rounds:
            own = staged(own.withColumn("odds", F.col("odds") + _by_kind({k: _walk(t, x) for k, t in trees.items()}, F.lit(0.0))), "odds")
    step = F.floor(_by_kind({k: m.score(x) for k, m in models.items()}, F.lit(0.0)) * SCORE_STEPS)
    scores = rows.where("held").groupBy("kind", step.alias("step")).agg(F.sum("n").alias("n"), F.sum(n * F.col("y")).alias("y"))
    down = Window.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = scores.select("kind", "step", F.sum("n").over(down).alias("n"), F.sum("y").over(down).alias("y"))
    held = taken.withColumn("low", F.max((F.col("y") / F.col("n") < precision).cast("int")).over(down)).where((F.col("low") == 0) & (F.col("y") >= least))
    for r in held.groupBy("kind").agg(F.min("step").alias("step")).collect():
        models[r["kind"]] = Model(models[r["kind"]].base, models[r["kind"]].trees, r["step"] / SCORE_STEPS - 1e-9)
    return models


def learn(found: DataFrame, seed: int = 3) -> dict[str, Model]:
    """A model per generator, from all of its candidates; a hash of the document and place deals them to the two halves."""
    return fit_counted(staged(examples(found, seed), "examples"))


def _free(spans: Column) -> Column:
    """Spans (start, rank, end, kind, base, score) in order without those of the method that overlap a base span."""
    last = _let(running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest),
                lambda ends: F.transform(spans, lambda s, i: F.coalesce(F.get(ends, i - 1), F.lit(0)) > s["start"]))
    far = F.lit(2**31 - 1)
    backwards = running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(far))), F.least)
    following = _let(backwards, lambda starts: F.transform(spans, lambda s, i: F.coalesce(F.get(starts, F.size(spans) - 2 - i), far) < s["end"]))
    clear = lambda before, after: F.filter(spans, lambda s, i: s["base"] | ~(F.get(before, i) | F.get(after, i)))
    return _let(last, lambda before: _let(following, lambda after: clear(before, after)))


def find_personal_data(docs: DataFrame, keep: Sequence[str] = (), seed: int = 3) -> DataFrame:
    """Spans of personal data in whole texts: ``doc_id, <keep>, spans``, a row per document.

    ``spans`` is an array of (start, rank, end, kind, base, score) by start,
    then kind: every valid match of the base patterns, with base true and score
    1, and the candidates of the other generators that the boosted trees score
    at or above their calibrated threshold and that no base span overlaps.
    Places are code points, ends exclusive.

    Trees learn from weak labels of all candidates of a generator; one half of
    them sets the thresholds.  All texts are searched, and candidates stay in
    their document's row; only counts of equal feature rows are shuffled.  Null and empty texts
    have no span.  Rows keep their doc_id, null or repeated.  An empty table
    gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in keep if c != "doc_id"],
                               candidates(text).alias("candidates")), "candidates")
    models = learn(found, seed)

    def judged(c: Column) -> Column:
        by_kind = F.lit(0.0)
        chosen = F.lit(False)
        for kind, model in models.items():
            by_kind = F.when(c["kind"] == kind, model.score(features(c))).otherwise(by_kind)
            chosen = F.when(c["kind"] == kind, by_kind >= F.lit(model.threshold)).otherwise(chosen)
        base = c["kind"].isin(*BASE)
        right = F.coalesce(valid(c["kind"], c["found"]), F.lit(False))
        rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).cast("int") - 1
        return F.when(F.when(base, right).otherwise(chosen), F.struct(
            c["start"].alias("start"), rank.alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"),
            base.alias("base"), F.when(base, F.lit(1.0)).otherwise(by_kind).alias("score")))

    spans = F.array_sort(F.filter(F.transform("candidates", judged), lambda s: s.isNotNull()))
    mixed = F.exists("spans", lambda s: s["base"]) & F.exists("spans", lambda s: ~s["base"])
    return found.select("doc_id", *[c for c in keep if c != "doc_id"], spans.alias("spans")).withColumn(
        "spans", F.when(mixed, _free(F.col("spans"))).otherwise(F.col("spans")))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, piece: int = 1024) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one, under the first kind.

    What stands between spans is put together from pieces of the text, so that
    many spans in a long text cost no more than its length.
    """
    n = F.size(spans)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def cut(parts: Column, ends: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / piece).cast("int")
            some = F.array_join(F.slice(parts, first + 1, F.floor(b / piece).cast("int") - first + 1), "")
            return F.substring(some, a - first * piece + 1, b - a)

        def replaced(s: Column, i: Column) -> Column:
            since = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when((s["start"] >= since), F.concat(between(since, s["start"]), label)).otherwise(F.lit(""))

        rest = between(F.get(ends, n - 1), F.char_length(text))
        return F.concat(F.array_join(F.transform(spans, replaced), ""), rest)

    to = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.coalesce(n, F.lit(0)) > 0, _let(pieces, lambda parts: _let(to, lambda ends: cut(parts, ends)))).otherwise(text)
