"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose candidates; five labelers vote +1, 0 or -1 on each: a rule of
the kind (checksums, issued ranges, letters mixed with digits), gazetteers of
its parts, cue words in the 48 code points before it, its boundaries, and how
many different characters it has. Expectation-maximisation over the
vote patterns estimates every labeler's reliability and a posterior for each
pattern; a logistic span classifier is then trained on votes, kind and shape
with these posteriors as targets, and decides the candidates. The corpus is
reduced to counts by (kind, votes, shape) before anything reaches the driver:
at most :data:`MAX_PATTERNS` rows, whatever the input.

The base spans (valid e-mail, IP, card and phone matches) always stay; the
classifier adds spans of the other kinds, or drops their candidates. Added
spans overlap neither a base span nor one another; of two kinds the one that
comes first in :data:`EXTRA` stays.

Defined cases: null and empty texts have no spans; repeated rows are found
alike; rows with null keys stay; an empty table gives an empty result; other
columns are left alone. The patterns are written with possessive repeats, so
texts of any length need neither deep recursion nor quadratic rescans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain, prefix_sums, read_table, restored, stored

BASE = {
    # \G or a look-behind: a run of name characters is tried once, from where it begins
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "spelt_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{2,}+)++",
    "local_phone": r"(?<![0-9.-])(?<!\+[0-9]{1,3}[\x20.-]?\(?)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\b\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
    # a value given to a name of secrets, or a long run of key characters wherever it is
    "secret": r"(?<![A-Za-z0-9])(?:(?i:pass(?:word|wd|phrase)|pwd|secret|token|credential|(?:api|access|private|auth)[_\x20-]?key)s?[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?[^\s\"'<>,;]{8,}+|[A-Za-z0-9+/_-]{20,}+={0,2})(?![A-Za-z0-9+/_=-])",
}
KINDS = [*BASE, *EXTRA]
#: What of a match comes before its span.
LEADS = {"secret": r"^(?i:pass(?:word|wd|phrase)|pwd|secret|token|credential|(?:api|access|private|auth)[_\x20-]?key)s?[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?"}

#: Gazetteers. Ends of mail domains: generic ones of the public root zone list, and countries by size of their zones.
DOMAINS = tuple("com org net edu gov mil int info biz name io co ai app dev me tv de uk fr es it nl eu ru pl br au ca us mx ar cl jp cn in kr ch at be se no dk fi cz pt gr ie nz za tr ua ro hu example test".split())
#: Given names that public birth statistics (United States, Germany, France, Spain) list as most common over the last century.
GIVEN = tuple(
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Paul Steven Andrew George Kevin "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Emily Laura Emma Olivia "
    "Hans Peter Karl Heinz Werner Klaus Wolfgang Jürgen Stefan Andreas Anna Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid "
    "Jean Pierre Michel André Philippe Louis Jacques Claude Nicolas Julien Marie Jeanne Françoise Monique Catherine Nathalie Isabelle Sylvie Camille Léa "
    "Antonio José Manuel Francisco Juan Javier Carlos Miguel Luis Alejandro María Carmen Josefa Isabel Ana Dolores Pilar Teresa Rosa Lucía".split()
)
#: Countries whose account numbers are IBANs, of the public registry's largest.
IBAN_COUNTRIES = tuple("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR UA".split())
#: How keys of well-known services begin, as their public documentation says.
KEY_STARTS = r"^(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|pk_|rk_|eyJ|hf_|npm_|ya29|SG)"
#: Words before a span that speak for it, and against it.
CUES = r"(?i)\b(?:e-?mail|mail|contact|phone|call|tel|mobile|fax|card|visa|account|iban|ssn|social security|address|name|reach|write to|signed|token|secret|pass(?:word|wd|phrase)|pwd|key|credential|auth|bearer)s?\b"
COUNTER_CUES = r"(?i)\b(?:order|version|isbn|issn|invoice|serial|section|chapter|figure|build|sku|ref|page|sha-?[0-9]*|md5|hash|commit|checksum|digest|uuid|http|https|file|path)\b"
VOTERS = ("checksum", "gazetteer", "context", "boundary", "variety")
SHAPES = ("digits9", "spaced", "long")
MAX_PATTERNS = len(KINDS) * 3 ** len(VOTERS) * 2 ** len(SHAPES)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    back, n = F.reverse(digits), F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def valid(kind: str, m: Column) -> Column:
    """The rule that a match of ``kind`` must pass, if it has one."""
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "national_id":
        return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if kind == "local_phone":
        return m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")
    if kind == "secret":
        return m.rlike("[A-Za-z]") & m.rlike("[0-9]") & ~m.rlike("^[A-Za-z]+[0-9]{1,4}$")
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
        mod = F.aggregate(
            F.split(turned, ""), F.lit(0),
            lambda r, c: F.when(c == "", r).when(c < "A", (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
        )
        return mod == 1
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    if "email" in kind:
        tail = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        return F.when(tail.isin(*DOMAINS), 1).when(tail.rlike("[0-9]"), -1).otherwise(0)
    if kind == "person":
        return F.when(m.rlike(r"\b(?:" + "|".join(GIVEN) + r")\b"), 1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(r"^0*(?:0|10|127|255|192\.168|169\.254)\."), -1).when(m.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), 1).otherwise(-1)
    if kind == "card":
        return F.when(m.rlike("^(?:4|5[1-5]|2[2-7]|34|37|6011|65)"), 1).otherwise(-1)
    if kind == "phone":  # zones of the international numbering plan
        return F.when(m.rlike(r"^\+(?:1|7|2[0-79]|3[0-69]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9])"), 1).otherwise(-1)
    if kind == "local_phone":  # area codes begin with 2 to 9 and aren't service codes
        return F.when(m.rlike(r"^\(?[2-9](?!11)[0-9]{2}"), 1).otherwise(-1)
    if kind == "national_id":
        return F.when(m.rlike("^(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6(?!66)[0-9]{2}|7[0-6][0-9]|77[0-2])"), 1).otherwise(-1)
    if kind == "iban":
        return F.when(F.left(m, F.lit(2)).isin(*IBAN_COUNTRIES), 1).otherwise(-1)
    # keys: a known beginning, or as many hexadecimal digits as keys and digests have
    return F.when(m.rlike(KEY_STARTS) | m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64})$"), 1).when(m.rlike("^[A-Za-z/_-]+$"), -1).otherwise(0)


def _candidate(kind: str, m: Column, start: Column, before: Column, after: Column) -> Column:
    if kind in LEADS:
        value = F.regexp_replace(m, LEADS[kind], "")
        lead = F.length(m) - F.length(value)
        m, start, before = value, start + lead, F.concat(before, F.left(m, lead))
    near, digits = F.right(before, F.lit(48)), F.length(_digits(m))
    last, following = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    glued = last.rlike(r"[\p{L}\p{N}_]") | following.rlike(r"[\p{L}\p{N}_]")
    bare = F.regexp_replace(m, r"[\x20().-]", "")
    kinds = F.size(F.array_distinct(F.split(bare, "")))
    ok = valid(kind, m)
    votes = {
        "checksum": F.when(ok, 1).otherwise(-1) if kind not in ("spelt_email", "person") else F.lit(0),
        "gazetteer": _gazetteer(kind, m),
        "context": F.when(near.rlike(CUES), 1).when(near.rlike(COUNTER_CUES), -1).otherwise(0),
        "boundary": F.when(glued, -1).otherwise(1),
        "variety": F.when(kinds >= (10 if kind == "secret" else 5), 1).when(kinds <= (5 if kind == "secret" else 2), -1).otherwise(0),
    }
    shapes = {"digits9": digits >= 9, "spaced": F.instr(m, " ") > 0, "long": F.length(m) >= 20}
    return F.struct(
        F.lit(kind).alias("kind"), start.cast("long").alias("s"), (start + F.length(m)).cast("long").alias("e"), ok.alias("ok"),
        *[v.cast("int").alias(k) for k, v in votes.items()], *[v.cast("int").alias(k) for k, v in shapes.items()],
    )


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with column ``_p_all``: the array of candidates with votes and shape, by kind and start.

    Where a pattern occurs, the text is split at it; the lengths of matches and
    gaps give the places in code points, and the gaps give the context.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hint = {"email": body.contains("@"), "phone": body.contains("+"), "iban": body.rlike("[A-Z]{2}[0-9]{2}")}
    first = {}
    for kind, pattern in (BASE | EXTRA).items():
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        first["_p_m_" + kind] = F.when(hint[kind], found).otherwise(F.array().cast("array<string>")) if kind in hint else found
    out = docs.withColumns(first)
    none = F.array().cast("array<string>")
    out = out.withColumns({"_p_g_" + k: F.when(F.size("_p_m_" + k) > 0, F.split(body, p, -1)).otherwise(none) for k, p in (BASE | EXTRA).items()})

    def steps(kind: str) -> Column:
        lengths = F.transform("_p_m_" + kind, lambda m, i: (F.length(F.get("_p_g_" + kind, i)) + F.length(m)).cast("long"))
        return F.when(F.size("_p_m_" + kind) > 0, prefix_sums(lengths))

    out = out.withColumns({"_p_o_" + k: steps(k) for k in KINDS})

    def made(kind: str) -> Column:
        g, o = F.col("_p_g_" + kind), F.col("_p_o_" + kind)
        return F.transform("_p_m_" + kind, lambda m, i: _candidate(kind, m, F.get(o, i) + F.length(F.get(g, i)), F.get(g, i), F.get(g, i + 1)))

    out = out.withColumns({"_p_c_" + k: made(k) for k in KINDS})
    return out.withColumn("_p_all", F.concat(*["_p_c_" + k for k in KINDS])).drop(*["_p_" + x + k for x in ("m_", "g_", "o_", "c_") for k in KINDS])


@dataclass
class Model:
    """Reliabilities of the labelers and weights of the span classifier."""

    reliability: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    threshold: float = 0.5

    def score(self, x: Column) -> Column:
        """The log-odds of candidate ``x``."""
        total = F.lit(float(self.weights.get("bias", -1e9)))
        for name, w in self.weights.items():
            column, _, value = name.partition("=")
            if value:
                total = total + F.when(x[column] == (value if column == "kind" else int(value)), F.lit(float(w))).otherwise(0.0)
        return total

    def accepts(self, x: Column) -> Column:
        return self.score(x) > math.log(self.threshold / (1 - self.threshold))


def pattern_counts(found: DataFrame) -> list[tuple[dict, int]]:
    """Counts by kind, votes and shape: the whole corpus in at most MAX_PATTERNS rows."""
    names = ["kind", *VOTERS, *SHAPES]
    rows = found.select(F.explode("_p_all").alias("x")).groupBy(*[F.col("x")[n].alias(n) for n in names]).count().orderBy(*names).collect()
    return [({n: r[n] for n in names}, r["count"]) for r in rows]


def expectation_maximisation(patterns: list[tuple[dict, int]], rounds: int = 50) -> tuple[list[float], dict]:
    """Posterior of each vote pattern, and P(vote | class) of each labeler.

    Classes are personal data or not; every kind has its own prior, kept off 0
    and 1. The majority vote is the start, so the classes keep their meaning.
    """
    post = [1 / (1 + math.exp(-sum(p[v] for v in VOTERS))) for p, _ in patterns]
    chance: dict = {}
    for _ in range(rounds):
        chance = {(v, x, c): 1.0 for v in VOTERS for x in (-1, 0, 1) for c in (0, 1)}
        prior = {k: [1.0, 1.0] for k in KINDS}
        for (p, n), q in zip(patterns, post):
            prior[p["kind"]][0] += n * (1 - q)
            prior[p["kind"]][1] += n * q
            for v in VOTERS:
                chance[v, p[v], 1] += n * q
                chance[v, p[v], 0] += n * (1 - q)
        for v in VOTERS:
            for c in (0, 1):
                total = sum(chance[v, x, c] for x in (-1, 0, 1))
                for x in (-1, 0, 1):
                    chance[v, x, c] /= total
        post = []
        for p, _ in patterns:
            a = [math.log(prior[p["kind"]][c] / sum(prior[p["kind"]])) + sum(math.log(chance[v, p[v], c]) for v in VOTERS) for c in (0, 1)]
            post.append(1 / (1 + math.exp(min(700.0, max(-700.0, a[0] - a[1])))))
    return post, chance


def train(patterns: list[tuple[dict, int]], rounds: int = 300, ridge: float = 1e-3) -> Model:
    """EM, then logistic regression on the posteriors by gradient steps over the counted patterns."""
    if not patterns:
        return Model()
    post, chance = expectation_maximisation(patterns)
    rows = []
    for p, n in patterns:
        names = ["bias", f"kind={p['kind']}"] + [f"{v}={p[v]}" for v in VOTERS if p[v]] + [f"{s}=1" for s in SHAPES if p[s]]
        rows.append((names, n))
    total = sum(n for _, n in rows)
    weights = {x: 0.0 for names, _ in rows for x in names}
    for _ in range(rounds):
        slope = {x: ridge * w for x, w in weights.items()}
        for (names, n), q in zip(rows, post):
            z = sum(weights[x] for x in names)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) * n / total
            for x in names:
                slope[x] += miss
        for x in weights:
            weights[x] -= 2.0 * slope[x]
    return Model({f"{v}:{x}:{c}": chance[v, x, c] for v, x, c in chance}, weights)


def spans(found: DataFrame, model: Model) -> DataFrame:
    """Adds ``_p_base`` and ``_p_added``: arrays of (kind, s, e)."""
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    out = found.withColumn("_p_base", F.transform(F.filter("_p_all", lambda x: x["kind"].isin(*BASE) & x["ok"]), bare))
    free = lambda x, marks: ~F.exists(marks, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    out = out.withColumn("_p_yes", F.filter("_p_all", lambda x: x["kind"].isin(*EXTRA) & model.accepts(x))).withColumn("_p_added", F.filter("_p_base", lambda x: F.lit(False)))
    for kind in EXTRA:  # spans of one kind don't overlap
        taken = F.concat("_p_base", "_p_added")
        own = F.filter("_p_yes", lambda x: (x["kind"] == kind) & free(x, taken))  # noqa: B023
        out = out.withColumn("_p_added", F.concat("_p_added", F.transform(own, bare)))
    return out.drop("_p_yes")


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_p_base`` and ``_p_added``. Candidates are found once and written; the model is trained on their counts."""
    found = stored(with_candidates(docs), "pii-candidates")
    return spans(found, train(pattern_counts(found)))


def redacted(text: Column, marks: Column) -> Column:
    """``text`` with every span of ``marks`` (sorted by start, not overlapping) replaced by <KIND>."""
    pieces = F.transform(marks, lambda x, i: F.concat(
        F.substring(text, (F.coalesce(F.get(marks, i - 1)["e"], F.lit(0)) + 1).cast("int"), (x["s"] - F.coalesce(F.get(marks, i - 1)["e"], F.lit(0))).cast("int")),
        F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    tail = F.substring(text, (F.get(marks, F.size(marks) - 1)["e"] + 1).cast("int"), F.length(text))
    return F.when(F.size(marks) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))


def merged(marks: Column) -> Column:
    """Spans by start with those that overlap an earlier one joined to it."""
    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (x["s"] < last["e"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    ordered = F.sort_array(F.transform(marks, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.aggregate(ordered, F.array().cast("array<struct<s:bigint,e:bigint,kind:string>>"), add)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(with_candidates(docs).drop("text"), "pii-candidates")
    out = spans(found, train(pattern_counts(found)))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("_p_base", lambda x: x["kind"] == k)).cast("long").alias("n_" + k)
    return out.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(joined(F.col("_p_base")), 256).alias("base_sha256"),
        joined(F.concat("_p_base", "_p_added")).alias("spans"),
        F.size("_p_added").cast("long").alias("n_added"), (F.size("_p_base") + F.size("_p_added")).cast("long").alias("n_spans"),
    )


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced in the text by its kind; ``n_chars`` follows."""
    used = ("text", "n_chars")
    found = detect(plain(docs, *used))
    out = found.withColumn("_p_marks", merged(F.concat("_p_base", "_p_added")))
    new = F.when(F.size("_p_marks") > 0, redacted(F.col("text"), F.col("_p_marks"))).otherwise(F.col("text"))
    out = out.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_p_marks") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(out, docs, *used)
