"""Operator 6: mixing documents to target weights of domains with soft membership. DataFrame functions only.

A table of labelled documents trains a classifier, naive Bayes over two kinds of evidence that SQL takes from the text: a few
binned shapes, and which of the TELLING tokens a text holds. Tokens are its words in lower case and its runs of marks; those
that tell the domains apart best (by log-likelihood ratio) are a table of bounded size. The classifier is fitted on at most LABELLED
labelled documents of each domain, the first by a digest of their ids; the domains' prior shares count all of them. It gives every document a distribution over domains. Document rates start at 1 and are fitted by projected gradient
steps of a least-squares problem: expected domain totals, the sum over documents of rate x words x share, shall match the
targets. The problem is scaled by the totals' own Gram matrix and steps are taken in the metric of the documents' words, so a
unit step is right and a document's change does not depend on its length. A step needs one sum a domain; the rate of a document
is a function of its shares and the few step vectors, so nothing is joined or collected by document. Steps end when no total
misses its target by more than TOLERANCE of all words, or after STEPS; what is left is returned with every row as residual, since
targets of domains that no document is likely to belong to cannot be met.

A rate becomes whole copies: its floor, plus one more with the probability of the rest, drawn by a digest of the id. Null texts
count as empty: no words, so they do not weigh. Documents without label only get shares. A document with several labels has the
first domain in order. Domains without labels get their prior share. An empty table gives no rows; rates stay 1 where the target
total is 0. Rows that share an id share the draw. A new column replaces an input column of its name, others stay; names that start
with two underscores are used on the way and must not be there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import written
from watchloom.operators.pinned import pinned

#: Domains, with the share of all words that each shall have.
TARGETS = {"good": 0.80, "low": 0.15, "toxic": 0.05}
BINS, STEPS, RIDGE, TELLING, TOLERANCE, LABELLED = 16, 12, 1e-9, 256, 0.002, 4000
WORD_GAP, MARK_GAP = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N} \t\n\r\f]+"
BLANK = "[ \\t\\n\\r\\f]+"
FEATURES = ("size", "word", "line", "stop", "shout", "bar")


def label_domain() -> Column:
    """The domain of a row of labels (quality, toxic)."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def tokens(text: str = "text") -> Column:
    """The distinct words of a text in lower case and its distinct runs of marks."""
    low = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.filter(F.array_union(F.split(low, WORD_GAP), F.split(low, MARK_GAP)), lambda x: x != "")


def telling_tokens(docs: DataFrame, labelled: DataFrame, domains: list[str], sizes: dict[str, int]) -> dict[str, list[int]]:
    """token -> labelled documents of each domain that hold it, of the TELLING tokens with the highest log-likelihood ratio."""
    known = docs.select("doc_id", "text").join(labelled, "doc_id").select("domain", F.explode(tokens()).alias("token"))
    counts = known.groupBy("token").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    total = sum(sizes.values())
    ratio = F.lit(0.0)
    for k, d in enumerate(domains):
        ratio = ratio + F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * F.log(F.col(f"n{k}") * F.lit(float(total)) / (F.col("n") * F.lit(float(max(sizes[d], 1)))))).otherwise(0.0)
    best = counts.withColumn("ratio", F.round(ratio, 4)).orderBy(F.desc("ratio"), "token").limit(TELLING)
    return {r["token"]: [r[f"n{k}"] for k in range(len(domains))] for r in best.collect()}


def features(docs: DataFrame, text: str = "text", telling: list[str] | None = None) -> DataFrame:
    """The documents with __words and __bins (counts of a few characters by word, each cut to BINS bins) and, if there are
    telling tokens, __held: those that the text holds."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\r\f"))
    with_words = pinned(docs, F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK))).cast("long").alias("__words"))
    held = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    by_word = lambda n, times: F.floor(F.lit(times) * n / F.greatest(F.col("__words"), F.lit(1)))
    values = [F.length(F.bin(F.length(t).cast("long"))), by_word(F.length(t), 1), by_word(held("\n"), 40), by_word(held("."), 40),
              by_word(held("!"), 10), by_word(held("|"), 10)]
    found = pinned(with_words, F.array(*[F.least(v, F.lit(BINS - 1)).cast("int") for v in values]).alias("__bins"))
    if telling is None:
        return found
    listed = F.array(*map(F.lit, telling)) if telling else F.array().cast("array<string>")
    return pinned(found, F.array_intersect(tokens(text), listed).alias("__held"))


def _summed(held: str, of: Column) -> Column:
    """The sum of a map's values over the tokens of an array."""
    return F.aggregate(held, F.lit(0.0), lambda s, t: s + F.element_at(of, t))


@dataclass
class Mixer:
    """Domains, log prior, log bin shares and log token shares of each, the step vectors of the fitted rates, and by how much
    the totals still miss the targets (share of all words)."""

    domains: list[str]
    prior: list[float]
    shares: dict[str, list[list[float]]]
    tokens: dict[str, list[float]]
    steps: list[list[float]]
    residual: float = 0.0

    def posterior(self, docs: DataFrame) -> DataFrame:
        """Adds __p, the shares of the domains in order, to documents with __bins and __held."""
        log = lambda x: F.log(F.lit(float(x)))
        sums = []
        for k, d in enumerate(self.domains):
            total = log(self.prior[k])
            for i in range(len(FEATURES)):
                total = total + F.element_at(F.array(*[log(x) for x in self.shares[d][i]]), F.col("__bins")[i] + 1)
            if self.tokens:
                of = F.create_map(*[x for t, v in self.tokens.items() for x in (F.lit(t), log(v[k]))])
                total = total + _summed("__held", of)
            sums.append(total)
        docs = pinned(docs, F.array(*sums).alias("__log"))
        docs = pinned(docs, F.transform("__log", lambda x: F.exp(x - F.array_max("__log"))).alias("__e"))
        total = sum((F.col("__e")[k] for k in range(1, len(self.domains))), F.col("__e")[0])
        return pinned(docs, F.transform("__e", lambda x: x / total).alias("__p")).drop("__log", "__e")

    def rate(self) -> Column:
        """The rate of a document with __p after all steps so far."""
        r = F.lit(1.0)
        for y in self.steps:
            move = F.lit(0.0)
            for k, v in enumerate(y):
                move = move + F.col("__p")[k] * F.lit(v)
            r = F.greatest(F.lit(0.0), r - move)
        return r


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, rounds: int = STEPS) -> tuple[Mixer, DataFrame]:
    """The fitted mixer, and the documents' (doc_id, __words, __p), from docs (doc_id, text) and labels (doc_id, domain)."""
    targets = targets or TARGETS
    domains = sorted(targets)
    one = labels.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    # at most LABELLED ids a domain, so they can be sent to the documents
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.md5(F.concat(F.lit("pick/"), F.col("doc_id").cast("string"))), "doc_id"))
    picked = F.broadcast(written(one.withColumn("place", place).where(F.col("place") <= LABELLED).drop("place"), "mix-labels"))
    sizes = lambda some: {d: 0 for d in domains} | {r["domain"]: r["n"] for r in docs.select("doc_id").join(some, "doc_id").groupBy("domain").agg(
        F.count("*").alias("n")).collect()}
    every, size = sizes(one), sizes(picked)
    telling = telling_tokens(docs, picked, domains, size)
    seen = written(features(docs.select("doc_id", "text"), telling=list(telling)).select("doc_id", "__words", "__bins", "__held"), "mix-features")
    known = seen.join(picked, "doc_id").select("domain", F.posexplode("__bins").alias("feature", "bin"))
    counts = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in known.groupBy("domain", "feature", "bin").agg(F.count("*").alias("n")).collect()}
    mixer = Mixer(domains, [(every[d] + 1) / (sum(every.values()) + len(domains)) for d in domains],
                  {d: [[(counts.get((d, f, b), 0) + 1) / (size[d] + BINS) for b in range(BINS)] for f in range(len(FEATURES))] for d in domains},
                  {t: [(n[k] + 0.5) / (size[d] + 1) for k, d in enumerate(domains)] for t, n in telling.items()}, [])
    placed = written(mixer.posterior(seen).select("doc_id", "__words", "__p"), "mix-shares")

    k = len(domains)
    weight = lambda i: F.col("__words") * F.col("__p")[i]
    gram = placed.agg(F.sum("__words"), *[F.sum(weight(i) * F.col("__p")[j]) for i in range(k) for j in range(i, k)]).first()
    total = float(gram[0] or 0)
    if not total:
        return mixer, placed
    flat = iter(float(v) / total for v in gram[1:])
    matrix = [[0.0] * k for _ in range(k)]
    for i in range(k):
        for j in range(i, k):
            matrix[i][j] = matrix[j][i] = next(flat)
    ridge = RIDGE * sum(matrix[i][i] for i in range(k))
    for i in range(k):
        matrix[i][i] += ridge
    scale = sum(targets.values())
    for done in range(rounds + 1):
        got = placed.agg(*[F.sum(mixer.rate() * weight(i)) for i in range(k)]).first()
        miss = [float(g) / total - targets[d] / scale for g, d in zip(got, domains)]
        mixer.residual = max(map(abs, miss))
        if mixer.residual <= TOLERANCE or done == rounds:
            break
        mixer.steps.append(solve(matrix, miss))
    return mixer, placed


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small system, one number a domain, by elimination with row exchange."""
    n = len(right)
    rows = [[*m, r] for m, r in zip(matrix, right)]
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for r in range(i + 1, n):
            f = rows[r][i] / rows[i][i]
            rows[r] = [x - f * y for x, y in zip(rows[r], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def copies(rate: Column) -> Column:
    """Whole copies of a document at a rate: the rest is drawn by a digest of the id."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.floor(F.round(rate, 4) + draw).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, p_<domain>, rate, copies and residual (the same for all) of every document (doc_id, text); labels: (doc_id, domain)."""
    mixer, placed = fit(docs, labels, targets)
    shares = [F.round(F.col("__p")[i], 6).alias(f"p_{d}") for i, d in enumerate(mixer.domains)]
    return placed.select("doc_id", F.col("__words").alias("n_words"), *shares, F.round(mixer.rate(), 4).alias("rate"), copies(mixer.rate()).alias("copies"),
                         F.lit(round(mixer.residual, 4)).alias("residual"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents with all their columns, each row as often as its rate says."""
    columns = [f"`{c}`" for c in docs.columns]
    mixer, _ = fit(docs, labels, targets)
    placed = pinned(mixer.posterior(features(docs, telling=list(mixer.tokens))), copies(mixer.rate()).alias("__copies")).where("__copies > 0")
    return placed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def oracle(targets: dict[str, float] | None = None, rounds: int = STEPS) -> str:
    """The same rates in SQL: three domains, the Gram matrix inverted by its adjugate."""
    targets = targets or TARGETS
    domains, scale = sorted(targets), sum(targets.values())
    t = "coalesce(text, '')"
    held = lambda c: f"(length({t}) - length(replace({t}, {c}, '')))"
    by_word = lambda n, times: f"floor({times} * {n} / greatest(words, 1)::DOUBLE)"
    values = [f"length(bin(length({t})::BIGINT))", by_word(f"length({t})", 1), by_word(held("chr(10)"), 40), by_word(held("'.'"), 40),
              by_word(held("'!'"), 10), by_word(held("'|'"), 10)]
    bins = ", ".join(f"least({v}, {BINS - 1})::INT" for v in values)
    when = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'good' END"
    blanks = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
    dom = " UNION ALL ".join(f"SELECT {i} AS k, '{d}' AS domain, {targets[d] / scale!r}::DOUBLE AS target" for i, d in enumerate(domains))
    p = [f"p{i}" for i in range(3)]
    parts = [f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text, trim({t}, {blanks}) AS body FROM documents),
counted AS MATERIALIZED (SELECT row, doc_id, text, CASE WHEN body = '' THEN 0 ELSE len(regexp_split_to_array(body, '[ \\t\\n\\r\\f]+')) END::BIGINT AS words FROM texts),
seen AS MATERIALIZED (SELECT row, doc_id, words, [{bins}] AS bins, list_distinct(list_concat(regexp_split_to_array(lower({t}), '{WORD_GAP}'), regexp_split_to_array(lower({t}), '{MARK_GAP}'))) AS tokens FROM counted),
dom AS ({dom}),
one AS (SELECT doc_id, min({when}) AS domain FROM labels WHERE {when} IS NOT NULL GROUP BY doc_id),
picked AS (SELECT doc_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('pick/' || doc_id::VARCHAR), doc_id) AS place FROM one) WHERE place <= {LABELLED}),
known AS MATERIALIZED (SELECT domain, bins, tokens FROM seen JOIN picked USING (doc_id)),
every_ AS (SELECT domain, count(*) AS n FROM seen JOIN one USING (doc_id) GROUP BY 1),
sizes AS (SELECT k, dom.domain, count(bins) AS size FROM dom LEFT JOIN known ON known.domain = dom.domain GROUP BY k, dom.domain),
long AS MATERIALIZED (SELECT row, u.f AS f, bins[u.f] AS bin FROM seen, (SELECT unnest(range(1, 7)) AS f) u),
spread AS (SELECT domain, unnest(tokens) AS token FROM known),
met AS (SELECT token, count(*) AS n, {', '.join(f"count(*) FILTER (domain = '{d}') AS n{i}" for i, d in enumerate(domains))} FROM spread WHERE token <> '' GROUP BY token),
telling AS MATERIALIZED (SELECT * FROM met, (SELECT sum(size)::DOUBLE AS every, {', '.join(f'greatest(max(size) FILTER (k = {i}), 1)::DOUBLE AS z{i}, max(size) FILTER (k = {i}) AS s{i}' for i in range(3))} FROM sizes)
  ORDER BY round({' + '.join(f'CASE WHEN n{i} > 0 THEN n{i} * ln(n{i} * every / (n * z{i})) ELSE 0.0 END' for i in range(3))}, 4) DESC, token LIMIT {TELLING}),
held AS (SELECT row, unnest(tokens) AS token FROM seen),
evidence AS MATERIALIZED (SELECT row, {', '.join(f'sum(ln((n{i} + 0.5) / (s{i} + 1))) AS v{i}' for i in range(3))} FROM held JOIN telling USING (token) GROUP BY row),
hits AS (SELECT domain, u.f AS f, bins[u.f] AS bin, count(*) AS n FROM known, (SELECT unnest(range(1, 7)) AS f) u GROUP BY 1, 2, 3),
shaped AS (SELECT row, k, any_value(ln((coalesce((SELECT n FROM every_ WHERE every_.domain = sizes.domain), 0) + 1)::DOUBLE / (coalesce((SELECT sum(n) FROM every_), 0) + 3))) + sum(ln((coalesce(n, 0) + 1)::DOUBLE / (size + {BINS}))) AS score
  FROM long CROSS JOIN sizes LEFT JOIN hits ON hits.domain = sizes.domain AND hits.f = long.f AND hits.bin = long.bin GROUP BY row, k),
logs AS (SELECT row, k, score + coalesce(CASE k WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END, 0) AS score FROM shaped LEFT JOIN evidence USING (row)),
soft AS (SELECT row, k, exp(score - max(score) OVER (PARTITION BY row)) AS e FROM logs),
wide AS (SELECT row, {', '.join(f'(sum(e) FILTER (k = {i})) / sum(e) AS p{i}' for i in range(3))} FROM soft GROUP BY row),
r0 AS MATERIALIZED (SELECT row, doc_id, words, p0, p1, p2, 1.0::DOUBLE AS rate FROM seen JOIN wide USING (row)),
gram AS MATERIALIZED (SELECT total, a + g AS a, b, c, d + g AS d, e, f + g AS f FROM (SELECT *, {RIDGE!r} * (a + d + f) AS g FROM (
  SELECT sum(words)::DOUBLE AS total, {', '.join(f'sum(words * {x} * {y}) / sum(words) AS {n}' for n, x, y in zip('abcdef', [p[0], p[0], p[0], p[1], p[1], p[2]], [p[0], p[1], p[2], p[1], p[2], p[2]]))} FROM r0))),
inv AS MATERIALIZED (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM gram)"""]
    miss = ", ".join(f"sum(rate * words * p{i}) / (SELECT total FROM gram) - {targets[domains[i]] / scale!r} AS m{i}" for i in range(3))
    for s in range(rounds):
        # within the tolerance nothing moves any more
        parts.append(f"""y{s} AS MATERIALIZED (SELECT CASE WHEN open THEN ((d*f-e*e)*m0 + (c*e-b*f)*m1 + (b*e-c*d)*m2) / det ELSE 0.0 END AS y0,
  CASE WHEN open THEN ((c*e-b*f)*m0 + (a*f-c*c)*m1 + (b*c-a*e)*m2) / det ELSE 0.0 END AS y1, CASE WHEN open THEN ((b*e-c*d)*m0 + (b*c-a*e)*m1 + (a*d-b*b)*m2) / det ELSE 0.0 END AS y2
  FROM (SELECT *, greatest(abs(m0), abs(m1), abs(m2)) > {TOLERANCE!r} AS open FROM (SELECT {miss} FROM r{s})), inv),
r{s + 1} AS MATERIALIZED (SELECT row, doc_id, words, p0, p1, p2, greatest(0.0, rate - (p0*y0 + p1*y1 + p2*y2)) AS rate FROM r{s}, y{s})""")
    parts.append(f"left_ AS (SELECT round(greatest(abs(m0), abs(m1), abs(m2)), 4) AS residual FROM (SELECT {miss} FROM r{rounds}))")
    draw = "('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return ",\n".join(parts) + f"""
SELECT doc_id, words AS n_words, {', '.join(f'round(p{i}, 6) AS p_{d}' for i, d in enumerate(domains))}, round(rate, 4) AS rate, floor(round(rate, 4) + {draw})::INT AS copies, residual FROM r{rounds}, left_"""
