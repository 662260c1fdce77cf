"""Soft-membership mixing in DataFrame functions only.

Labelled rows give domains: ``toxic`` (toxic = 1), else ``good`` (quality = 1), else ``poor``. A naive Bayes model over words and coarse
shape features is fitted on at most ``fit_rows`` labelled documents (chosen by a hash of their ids). Its scores are calibrated on them: one factor,
the best of ``FACTORS`` by log loss, as naive Bayes is too sure, and an offset a domain, so that the posteriors' sums are the domains' counts. A document's
posterior is the softmax of its calibrated scores. Then nonnegative document rates w are fitted by projected-gradient least squares so that expected domain totals
A w, with A[k, d] = tokens of d times its posterior of k, match the targets b: min |A w - b|^2, w >= 0, with the gradient taken in the
metric of tokens,

    w <- max(0, w + p' S (b - A w)),  from w = 1.

Where no rate is at 0, the residual goes by (I - G S) with G = A diag(1 / tokens) A'. The first steps are scaled by S = the inverse of G (over the
documents with a rate above 0), which ends the residual at once where no rate is at 0; a residual of 0 is the least squares' minimum in any scale. When these steps gain no more, targets can't all be met, and
plain gradient steps go on, S = a length by the last step's secant (Barzilai and Borwein's two, in turn); of these the best is kept. The fit ends at a residual of ``TOLERANCE`` of the budget, when ``PATIENCE`` steps
gain less than a tenth of that (what is left can't be met), or after ``STEPS``; ``fit_rates`` returns target and reached total of each domain in any case.

A step needs a few sums over all documents, which return to the driver; a document's rate is a fold over the steps so far,
so nothing is written between steps.

A domain without a target takes no part in the fit: documents that belong to it with a chance of ``DOUBT`` or more go (rate 0), and the targets of the others are met by what is left.

Edge cases: null texts are empty, have no tokens, and keep the rate their posterior gives; without labels all domains are equally
likely; null ids take part; repeated rows get equal rates; a target that no document can serve stays unmet and is reported by ``totals``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, fresh, materialize, quoted, text_of
from vellum.llm.quality import bound, words_of

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.88, "poor": 0.1, "toxic": 0.02}
#: Labelled documents of the fit at most; documents that must hold a word; least evidence for some domain (log ratio) and number of words of the model; prior documents.
FIT_ROWS, LEAST_DOCS, LEAST_EFFECT, MODEL_WORDS, PRIOR = 20_000, 8, 0.7, 128, 3.0
#: Factors of the scores among which calibration chooses, and its turns of offsets.
FACTORS, OFFSET_TURNS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0), 5
#: Chance of a domain without a target at which a document goes.
DOUBT = 0.25
#: Steps at most, steps without a gain before the end, and the residual at which they end, as a share of the budget.
STEPS, PATIENCE, TOLERANCE = 24, 6, 1e-4


def _bin(share: Column, edges: tuple[float, ...], name: str) -> Column:
    def of(x: Column) -> Column:
        out = F.lit(f"{name}:{len(edges)}")
        for i in reversed(range(len(edges))):
            out = F.when(x < edges[i], F.lit(f"{name}:{i}")).otherwise(out)
        return out

    return bound(share, of)


def features(text: Column) -> Column:
    """Distinct lower-case words of letters, and shape features: shares of symbols and capitals, of distinct words, and the length."""
    n = F.greatest(F.length(text), F.lit(1))
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|!<>", ""))) / n
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / n

    def of(words: Column) -> Column:
        variety = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
        shape = F.array(_bin(symbols, (1e-9, 0.01, 0.03, 0.1, 0.3), "symbols"), _bin(capitals, (1e-9, 0.03, 0.1, 0.3, 0.6), "capitals"), _bin(variety, (0.1, 0.2, 0.4, 0.6, 0.8), "variety"), _bin(F.size(words).cast("double"), (10.0, 50.0, 200.0, 1000.0, 5000.0), "length"))
        return F.concat(shape, words)

    return bound(F.split(F.lower(text), "\\P{L}+"), of)


def label() -> Column:
    """A labelled row's domain."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """The model of a bounded number of labelled documents."""
    rows = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id_"), label().alias("domain"))
    rows = rows.orderBy(F.xxhash64("id_"), "domain").limit(fit_rows)  # at most fit_rows rows of a number and a word are sent to all tasks
    known = docs.select(F.col(key).cast("long").alias("id_"), text_of(text).alias("t")).join(F.broadcast(rows), "id_").select("domain", features(F.col("t")).alias("f"))
    known = materialize(known.select("domain", F.array_distinct("f").alias("f")), "mix-known")
    sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    counts = known.select("domain", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *(F.sum((F.col("domain") == d).cast("int")).alias(d) for d in DOMAINS)).where(F.col("n") >= LEAST_DOCS)
    effects = [F.log((F.col(d) + PRIOR) / (F.col("n") * (sizes.get(d, 0) / max(1, total)) + PRIOR)) for d in DOMAINS]
    strong = counts.select("f", "n", F.array(*effects).alias("e"))
    strong = strong.where((F.array_max("e") >= LEAST_EFFECT) | F.col("f").contains(":"))
    strong = strong.withColumn("worth", F.when(F.col("f").contains(":"), F.lit(1e18)).otherwise(F.col("n") * F.array_max("e")))
    model = {r.f: list(r.e) for r in strong.orderBy(F.desc("worth"), "f").limit(MODEL_WORDS).collect()}
    scored = materialize(known.select("domain", _scores(F.col("f"), model, priors).alias("s")), "mix-scored")
    right = F.create_map(*(x for i, d in enumerate(DOMAINS) for x in (F.lit(d), F.lit(i + 1))))[F.col("domain")]
    chance = lambda factor, offsets: _softmax(F.col("s"), factor, offsets)
    factor, offsets = 1.0, [0.0] * len(DOMAINS)
    if total:
        loss = scored.agg(*(F.sum(-F.log(F.greatest(F.element_at(chance(x, offsets), right), F.lit(1e-12)))).alias(str(i)) for i, x in enumerate(FACTORS))).first()
        factor = FACTORS[min(range(len(FACTORS)), key=lambda i: loss[i])]
        for _ in range(OFFSET_TURNS):
            sums = scored.agg(*(F.sum(F.element_at(chance(factor, offsets), i + 1)).alias(d) for i, d in enumerate(DOMAINS))).first()
            offsets = [o + math.log((sizes.get(d, 0) + 0.5) / (sums[d] + 0.5)) for o, d in zip(offsets, DOMAINS, strict=True)]
    discard(known, scored)
    return Model(model, priors, factor, offsets)


@dataclass(frozen=True)
class Model:
    """Log evidence of features for the domains, log priors, and the calibration of the scores: a factor and an offset for each domain."""

    evidence: dict[str, list[float]]
    priors: list[float]
    factor: float
    offsets: list[float]


def _softmax(scores: Column, factor: float, offsets: list[float]) -> Column:
    z = [F.get(scores, i) * factor + o for i, o in enumerate(offsets)]
    top = F.greatest(*z)
    return bound(F.array(*(F.exp(x - top) for x in z)), lambda e: F.transform(e, lambda x: x / sum((F.get(e, i) for i in range(len(z))), F.lit(0.0))))


def _scores(f: Column, evidence: dict[str, list[float]], priors: list[float]) -> Column:
    scores: Column = F.array(*map(F.lit, priors))
    if not evidence:
        return scores
    names = F.array(*map(F.lit, evidence))
    effects = F.create_map(*[x for name, e in evidence.items() for x in (F.lit(name), F.array(*map(F.lit, e)))])
    return F.aggregate(F.array_intersect(f, names), scores, lambda a, x: F.zip_with(a, F.element_at(effects, x), lambda p, q: p + q))


def posteriors(text: Column, model: Model) -> Column:
    """Array of the domains' posteriors."""
    return bound(_scores(features(text), model.evidence, model.priors), lambda s: _softmax(s, model.factor, model.offsets))


def _solve(g: list[list[float]], r: list[float]) -> list[float]:
    """g x = r by elimination with pivots; unidentified directions stay 0."""
    k, rows = len(r), [[*a, b] for a, b in zip(g, r, strict=True)]
    floor = 1e-12 * max(max(map(abs, a)) for a in g) or 1.0
    used: list[tuple[int, int]] = []
    for c in range(k):
        free = [i for i in range(k) if i not in [u for u, _ in used]]
        p = max(free, key=lambda i: abs(rows[i][c]))
        if abs(rows[p][c]) <= floor:
            continue
        used.append((p, c))
        for i in range(k):
            if i != p and rows[i][c]:
                f = rows[i][c] / rows[p][c]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[p], strict=True)]
    out = [0.0] * k
    for p, c in used:
        out[c] = rows[p][k] / rows[p][c]
    return out


def _largest_eigenvalue(g: list[list[float]]) -> float:
    """Of a symmetric matrix without negative eigenvalues, by its powers."""
    v = [1.0] * len(g)
    top = 0.0
    for _ in range(200):
        v = [sum(a * x for a, x in zip(row, v, strict=True)) for row in g]
        top = math.sqrt(sum(x * x for x in v))
        if top == 0:
            return 0.0
        v = [x / top for x in v]
    return top


def rate_of(posterior: Column, steps: list[list[float]], targets: dict[str, float] = TARGETS) -> Column:
    """A document's rate after the steps: nothing where it belongs to domains without a target with a chance of ``DOUBT`` or more."""
    each = F.array(*(F.array(*map(F.lit, c)) for c in steps))
    dot = lambda c: sum((F.element_at(posterior, i + 1) * F.element_at(c, i + 1) for i in range(len(DOMAINS))), F.lit(0.0))
    rate = F.aggregate(each, F.lit(1.0), lambda w, c: F.greatest(F.lit(0.0), w + dot(c))) if steps else F.lit(1.0)
    none = [F.element_at(posterior, i + 1) for i, d in enumerate(DOMAINS) if not targets.get(d)]
    return F.when(sum(none, F.lit(0.0)) >= DOUBT, 0.0).otherwise(rate) if none else rate


def fit_rates(members: DataFrame, *, targets: dict[str, float] = TARGETS, budget: float | None = None, grow: bool = False) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """Steps for ``rate_of`` from members(n_tokens, posterior), and for each domain (target, expected total).

    budget: tokens in all; by default what the domains with a target hold; with grow, the least at which the largest of these doesn't shrink.
    """
    k = len(DOMAINS)
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    n = F.col("n_tokens").cast("double")

    def sums(steps: list[list[float]]) -> tuple[list[float], list[list[float]], float]:
        """A w, G over the documents with a rate above 0, and the square of the last step's change of rates in tokens."""
        rated = members.withColumn("w_", rate_of(F.col("posterior"), steps, targets)).withColumn("v_", rate_of(F.col("posterior"), steps[:-1], targets))
        on = F.when(F.col("w_") > 0, n).otherwise(0.0)
        moved = F.col("w_") - F.col("v_")
        row = rated.agg(F.sum(n * moved * moved).alias("m"), *(F.sum(n * p[i] * F.col("w_")).alias(f"t{i}") for i in range(k)), *(F.sum(on * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(i, k))).first()
        value = lambda name: float(row[name] or 0.0)
        cell = lambda i, j: value(f"g{min(i, j)}{max(i, j)}") if goal[i] and goal[j] else 0.0
        return [value(f"t{i}") for i in range(k)], [[cell(i, j) for j in range(k)] for i in range(k)], value("m")

    share = sum(targets.values()) or 1.0
    goal = [targets.get(d, 0.0) / share for d in DOMAINS]
    first = members.agg(*(F.sum(n * p[i]).alias(f"t{i}") for i in range(k))).first()
    have = [float(first[f"t{i}"] or 0.0) for i in range(k)]
    if budget is None:
        budget = max((h / g, h, g) for h, g in zip(have, goal, strict=True) if g == max(goal))[0] if grow else sum(h for h, g in zip(have, goal, strict=True) if g > 0)
    b = [g * budget for g in goal]
    size = lambda r: math.sqrt(sum(x * x for x in r))
    short = lambda got: [x - y if g else 0.0 for x, y, g in zip(b, got, goal, strict=True)]
    got, whole, _ = sums([])
    steps: list[list[float]] = []
    done = lambda got: budget <= 0 or max(map(abs, short(got))) <= TOLERANCE * budget
    gram, passes = whole, 0
    while not done(got) and passes < STEPS:
        passes += 1
        made = [*steps, _solve(gram, short(got))]
        now, then, _ = sums(made)
        gain = size(short(got)) - size(short(now))
        if gain > 0:
            steps, got, gram = made, now, then
        if gain <= TOLERANCE / 10 * budget:
            break
    # Plain gradient steps, of lengths by the last step's secant; these needn't lessen the residual each time, so the best is kept.
    top = _largest_eigenvalue(whole)
    trail, at, length, idle = list(steps), got, 1 / top if top > 0 else 0.0, 0
    while not done(got) and passes < STEPS and length > 0 and idle < PATIENCE:
        passes += 1
        trail = [*trail, [length * x for x in short(at)]]
        now, _, moved = sums(trail)
        change = [x - y for x, y in zip(now, at, strict=True)]
        along, across = sum(x * x for x in change), sum(x * y * whole[i][j] for i, x in enumerate(change) for j, y in enumerate(change))
        if along > 0:
            length = moved / along if passes % 2 else along / across
        gain, at, idle = size(short(got)) - size(short(now)), now, idle + 1
        if gain > 0:
            idle = idle if gain <= TOLERANCE / 10 * budget else 0
            steps, got = trail, now
        if along == 0:
            break
    return steps, {d: (b[i], got[i]) for i, d in enumerate(DOMAINS)}


def mix(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", targets: dict[str, float] = TARGETS, budget: float | None = None, grow: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens (words), posterior, rate, and copies: the rate rounded up or down by a hash of the
    id so that its mean is the rate. A written table."""
    model = fit(docs, labels, text=text, key=key)
    t = text_of(text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.size(words_of(t)).cast("long").alias("n_tokens"), posteriors(t, model).alias("posterior"))
    members = materialize(rows, "mix-members")
    steps, _ = fit_rates(members, targets=targets, budget=budget, grow=grow)
    rate = rate_of(F.col("posterior"), steps, targets)
    return members.withColumn("rate", rate).withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def copies_of(rate: Column, key: Column) -> Column:
    return bound(rate, lambda r: _rounded(r, key))


def _rounded(rate: Column, key: Column) -> Column:
    part = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + part).cast("int")


def totals(rows: DataFrame, targets: dict[str, float] = TARGETS) -> dict[str, tuple[float, float]]:
    """For each domain its target and its share of the expected tokens after copies, from rows(n_tokens, posterior, copies)."""
    each = (F.sum(F.col("n_tokens") * F.col("copies") * F.element_at("posterior", i + 1)) for i in range(len(DOMAINS)))
    got = [float(x or 0.0) for x in rows.agg(*(x.alias(d) for x, d in zip(each, DOMAINS, strict=True))).first()]
    want, have = sum(targets.values()) or 1.0, sum(got) or 1.0
    return {d: (targets.get(d, 0.0) / want, x / have) for d, x in zip(DOMAINS, got, strict=True)}


def mixed_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", targets: dict[str, float] = TARGETS, grow: bool = True) -> DataFrame:
    """docs, each as often as its copies say; columns as in docs. Documents labelled as of a domain without a target go, too."""
    model = fit(docs, labels, text=text, key=key)
    none = [d for d in DOMAINS if not targets.get(d)]
    if none:
        i = fresh(docs, "id")
        named = labels.where(label().isin(none) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias(i)).distinct()
        docs = docs.join(materialize(named, "mix-named"), F.col(key).cast("long") == F.col(i), "left_anti")
    # The posteriors are computed once and written with the documents.
    p, n, w = fresh(docs, "posterior"), fresh(docs, "n_tokens"), fresh(docs, "copies")
    t = text_of(text)
    rated = materialize(docs.withColumn(n, F.size(words_of(t)).cast("long")).withColumn(p, posteriors(t, model)), "mix-documents")
    steps, _ = fit_rates(rated.select(F.col(n).alias("n_tokens"), F.col(p).alias("posterior")), targets=targets, grow=grow)
    copies = copies_of(rate_of(F.col(p), steps, targets), F.col(key))
    return rated.withColumn(w, F.explode(F.array_repeat(F.lit(1), copies))).select(*(F.col(quoted(c)) for c in docs.columns))
