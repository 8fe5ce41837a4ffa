"""Personal data: fixed patterns, and boosted trees over the spans that generous generators propose.

Everything that touches the corpus is DataFrame functions: matches come from `regexp_extract_all`, their places from the
lengths of what `split` leaves between them, features and scores are expressions over arrays in the document's own row.
Nothing is shuffled. Only the trees are grown on the driver, from a bounded sample of candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.llm.text_classes import stored

# The contract's patterns and the order of kinds. Written so that Java's engine neither recurses nor tries a
# long run of letters or digits from each of its places: possessive repeats, and starts only where a run starts or, for
# mail names, where the match before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: mail names with spaces or spelled signs, numbers of 7 to 31 digits, hexadecimal addresses.
PROPOSED = {
    "handle": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[a-z0-9-]{1,63}+(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.\x20?)[a-z0-9-]{1,63}+){1,6}+",
    "number": r"(?<![A-Za-z0-9.,])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,30}+",
    "network": r"(?i)(?<![0-9a-z:.-])[0-9a-f]{1,4}(?:[:-][0-9a-f]{1,4}){3,7}+(?![0-9a-z:])",
}
KINDS = (*BASE, *PROPOSED)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(e.v, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": f"e.v rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'",
    "card": f"length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
#: Where a text lacks this, it has no match.
_HINT = {"email": "contains(text, '@')", "ip": "digits", "card": "digits", "phone": "digits and contains(text, '+')",
         "handle": "contains(text, '@') or text rlike r'(?i)[ (\\[]at[ )\\]]'", "number": "digits", "network": "digits and text rlike '[0-9A-Fa-f][:-][0-9A-Fa-f]'"}
_CHUNK = 256
_BEFORE, _AFTER = 24, 12

_WORDS = {
    "phone": "tel|phone|call|mobile|cell|fax|sms|whatsapp|telefon|t[eé]l[eé]fono?|handy|m[oó]vil|ruf",
    "account": "ssn|social|card|account|iban|passport|tax|id|konto|ausweis|compte|cuenta|carte|tarjeta",
    "mail": "mail|contact|write|reach|kontakt|correo|courriel",
    "host": "ip|mac|host|server|address|adresse|router|direcci[oó]n",
    "neutral": "version|page|isbn|issn|doi|total|no|nr|art|fig|section|year|vol|rfc|line|date|build|copyright|seite|p[aá]gina",
}


def _text_features() -> dict[str, str]:
    """Format and context of a candidate `e`, as SQL over its value and what stands beside it."""
    has = {"paren": "[()]", "dot": "[.]", "slash": "/", "space": " ", "dash": "-", "colon": ":", "at": "@", "bracket": r"[(\[](?i:at|dot)[)\]]", "spelled": "(?i) (?:at|dot) "}
    groups = "regexp_extract_all(e.v, '[0-9]+', 0)"
    parts = "split(e.v, '[^0-9A-Za-z]+')"
    return {
        "digits": f"length({_DIGITS})",
        "letters": "length(regexp_replace(e.v, '[^A-Za-z]', ''))",
        "length": "length(e.v)",
        "groups": f"size({groups})",
        "longest": f"coalesce(array_max(transform({groups}, x -> length(x))), 0)",
        "first": f"coalesce(length(get({groups}, 0)), 0)",
        "last": f"coalesce(length(element_at({parts}, -1)), 0)",
        "parts": f"size({parts})",
        "marks": "size(array_distinct(split(regexp_replace(e.v, '[0-9A-Za-z]', ''), '')))",
        **{f"has_{k}": f"if(e.v rlike r'{p}', 1, 0)" for k, p in has.items()},
        "luhn": f"if(length({_DIGITS}) between 12 and 19, if(luhn_check({_DIGITS}), 1, 0), 0)",
        "dated": "if(e.v rlike '(?:19|20)[0-9]{2}[-./ ](?:0?[1-9]|1[0-2])[-./ ]|[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:19|20)[0-9]{2}', 1, 0)",
        "one_digit": f"if({_DIGITS} rlike '^(.)(?:\\\\1)*$', 1, 0)",
        **{f"near_{k}": f"if(e.before rlike '(?i)(?<![a-z])(?:{w})[a-z]{{0,8}}[^a-z0-9]{{0,6}}$', 1, 0)" for k, w in _WORDS.items()},
        "money": "if(e.before rlike '[$€£#] ?$', 1, 0)",
        "plus": "if(e.before rlike '[+] ?$', 1, 0)",
        "joined": "if(e.after rlike '^[0-9A-Za-z%_=]', 1, 0)",
        "decimal": "if(e.after rlike '^[.,:][0-9]', 1, 0)",
    }


FEATURES = tuple(_text_features())


def _placed(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds `kind`: the pattern's matches, leftmost and non-overlapping, as (a, b, v, before, after); places in code points.

    Lengths are summed up in two levels, so that a text with many matches does not take a pass over all for each.
    """
    m, g, c, s = (f"{kind}_{x}" for x in ("m", "g", "c", "s"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn(m, F.when(F.expr(_HINT[kind]), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(none))
    rows = rows.withColumn(c, F.expr(f"zip_with({m}, slice({g}, 1, size({m})), (x, y) -> named_struct('gap', length(y), 'n', length(x)))"))
    rows = rows.withColumn(c, F.expr(f"transform(sequence(0, cast((size({c}) - 1) div {_CHUNK} as int)), j -> slice({c}, j * {_CHUNK} + 1, {_CHUNK}))"))
    rows = rows.withColumn(s, F.expr(f"transform({c}, x -> aggregate(x, 0L, (t, e) -> t + e.gap + e.n))"))
    rows = rows.withColumn(s, F.expr(f"transform({s}, (x, j) -> aggregate(slice({s}, 1, j), 0L, (t, e) -> t + e))"))
    rows = rows.withColumn(s, F.expr(f"flatten(zip_with({c}, {s}, (x, h) -> transform(x, (e, i) -> h + e.gap + aggregate(slice(x, 1, i), 0L, (t, q) -> t + q.gap + q.n))))"))
    beside = f", 'before', right({g}[i], {_BEFORE}), 'after', left({g}[i + 1], {_AFTER})" if kind in PROPOSED else ""
    rows = rows.withColumn(kind, F.expr(f"transform({m}, (x, i) -> named_struct('a', {s}[i], 'b', {s}[i] + length(x), 'v', x{beside}))"))
    return rows.drop(m, g, c, s)


def _overlaps(kind: str) -> str:
    """Whether candidate `e` overlaps one of the kind's spans, which are sorted and apart: binary search for the last that starts before its end."""
    middle = "cast((s.lo + s.hi) div 2 as int)"
    index = (f"aggregate(sequence(1, length(bin(size({kind})))), named_struct('lo', 0, 'hi', size({kind})), (s, k) -> case when s.lo >= s.hi then s "
             f"when {kind}[{middle}].a < e.b then named_struct('lo', {middle} + 1, 'hi', s.hi) else named_struct('lo', s.lo, 'hi', {middle}) end, s -> s.lo)")
    return f"coalesce(get({kind}, {index} - 1).b > e.a, false)"


def _with_base(rows: DataFrame) -> DataFrame:
    for kind, pattern in BASE.items():
        rows = _placed(rows, kind, pattern)
        rows = rows.withColumn(kind, F.expr(f"filter({kind}, e -> {_VALID[kind]})"))
    return rows


def _with_candidates(rows: DataFrame, mark: str = "") -> DataFrame:
    """Adds `candidates`: (a, b, family, marked, f) of every proposed span that overlaps no base span; f are its features.

    `marked` says whether `mark` stands right before it; the mark itself is not part of the context.
    """
    context = f"regexp_replace(e.before, '{mark}', '')" if mark else "e.before"
    for kind, pattern in PROPOSED.items():
        rows = _placed(rows, kind, pattern)
        rows = rows.withColumn(kind, F.expr(f"filter({kind}, e -> not ({' or '.join(_overlaps(b) for b in BASE)}))"))
        rows = rows.withColumn(kind, F.expr(f"transform({kind}, e -> named_struct('a', e.a, 'b', e.b, 'v', e.v, 'before', {context}, 'after', e.after, 'marked', " + (f"endswith(e.before, '{mark}')" if mark else "false") + "))"))
        f = ", ".join(f"double({x})" for x in _text_features().values())
        rows = rows.withColumn(kind, F.expr(f"transform({kind}, e -> named_struct('a', e.a, 'b', e.b, 'family', {KINDS.index(kind)}, 'marked', e.marked, 'f', array({f})))"))
    return rows.withColumn("candidates", F.concat(*PROPOSED)).drop(*PROPOSED)


# -- the model ----------------------------------------------------------------------------------

@dataclass
class Boosted:
    """Regression trees for the log-odds of a candidate, by family; and the least log-odds that select it.

    A tree is (feature, value, low side, high side), a leaf a number; low is at most the value.
    """

    start: dict[str, float]
    trees: dict[str, list]
    threshold: dict[str, float]

    def score(self, family: str, x: np.ndarray) -> np.ndarray:
        def walk(node, at):
            if not isinstance(node, tuple):
                return np.full(int(at.sum()), node)
            low = x[at, node[0]] <= node[1]
            out = np.empty(int(at.sum()))
            for side, child in ((low, node[2]), (~low, node[3])):
                part = at.copy()
                part[at] = side
                out[side] = walk(child, part)
            return out

        return self.start[family] + sum((walk(t, np.ones(len(x), bool)) for t in self.trees[family]), np.zeros(len(x)))

    def sql(self, family: str) -> str:
        """The log-odds of candidate `e`, as an expression."""
        def walk(node):
            return f"case when e.f[{node[0]}] <= {node[1]!r}D then {walk(node[2])} else {walk(node[3])} end" if isinstance(node, tuple) else f"{node!r}D"

        return " + ".join([f"{self.start[family]!r}D", *(f"({walk(t)})" for t in self.trees[family])])


def grow(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, least: float = 2.0) -> tuple[float, list]:
    """Gradient boosting of the logistic loss: each tree takes Newton steps on the gradients of the ones before."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), start), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1], method="lower")) for j in range(x.shape[1])]
    cell = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)

    def split(at: np.ndarray, level: int):
        g, h = grad[at].sum(), hess[at].sum()
        best, where = 1e-6, None
        if level < depth:
            for j, c in enumerate(cuts):
                gl = np.cumsum(np.bincount(cell[at, j], grad[at], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(cell[at, j], hess[at], len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < least) | (h - hl < least)] = 0
                if len(gain) and gain.max() > best:
                    best, where = float(gain.max()), (j, int(gain.argmax()))
        if where is None:
            step = float(rate * g / (h + 1))
            score[at] += step
            return step
        low = cell[at, where[0]] <= where[1]
        return (where[0], float(cuts[where[0]][where[1]]), split(at[low], level + 1), split(at[~low], level + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        trees.append(split(np.arange(len(y)), 0))
    return start, trees


#: Stands before what a rewritten text holds in place of a base match; no text of the corpus is changed.
_MARK = "\ue000"
_EMAIL, _PHONE = r"([A-Za-z0-9._%+-]++)@([A-Za-z0-9-]++)\.([A-Za-z0-9-]++)", r"\+[0-9]{1,3}[\x20-]?\(?([0-9]{2})([0-9])\)?[\x20-]?([0-9]{3})[\x20-]?([0-9]{2})([0-9]{2})"
_IP, _CARD = r"\b([0-9]{1,2})[0-9]?\.([0-9]{1,2})[0-9]?\.([0-9]{1,2})[0-9]?\.([0-9]{1,2})[0-9]?\b", r"\b([0-9]{3})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{4,10})\b"
#: What base matches (mail, phone, card, ip) become in a rewriting: personal data in looser spellings, then look-alikes that are none.
LOOSE = [
    (f"{_MARK}$1 (at) $2 (dot) $3", f"{_MARK}$1$2$3$4$5", f"ssn {_MARK}$1-$2-$3$4", f"{_MARK}fe80:$1:$2:$3:$4"),
    (f"{_MARK}$1 @ $2.$3", f"tel. {_MARK}$1$2 $3 $4$5", f"{_MARK}$1-$2-$3$4", f"{_MARK}0a:5e:$1:$2:$3:$4"),
    (f"mail {_MARK}$1 [at] $2.$3", f"phone: {_MARK}0$1$2$3$4$5", f"card {_MARK}$1$2 $3$4 $5", f"ip {_MARK}2001:$1:$2:$3:$4:$1:$2:$3"),
    (f"{_MARK}$1 at $2 dot $3", f"call {_MARK}($1$2) $3-$4$5", f"{_MARK}$1$2-$3$4-$5", f"mac {_MARK}0a-5e-$1-$2-$3-$4"),
    (f"contact: {_MARK}$1 (at) $2.$3", f"{_MARK}($1$2) $3-$4$5", f"account {_MARK}$5$1$2", f"address {_MARK}fe80:$1:$2:$3:$4:$3"),
]
PLAIN = [
    ("look at $2. $3", "2019-0$2-1$2 1$2:$4", "isbn 978-$1-$2-$3$4-0", "1$1:2$2:3$3:4$4"),
    ("met at $3.$2", "12/0$2/1998 20$4", "0.$1$2$3$4", "20$1-$2-$3-$4"),
    ("one at noon. $2", "no. 20$4/$2/00123", "total $ $1 $2$3 $4$4", "a-$1-b-$2-c"),
    ("$3 at $2.", "20$4-1$2-0$2 to 20$5-0$2-1$2", "$1/$2/$3/$4", "5-$1-$2-$3"),
    ("at $2. The $3", "page $3 ($4) $5 $1 $2", "$1 $2 $3 $4", "$1:$2:$3:$4"),
]


def fit(docs: DataFrame, sample: int = 6000, candidates: int = 30_000, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.99,
        id_col: str = "doc_id", text_col: str = "text") -> Boosted | None:
    """Grow the trees on candidates of at most `sample` documents (least hash of the id), at most `candidates` of a family.

    There are no labels: base matches teach. The sample's texts are written anew with each base match in a looser
    spelling (positive), and with a look-alike in its place (negative, as all other candidates). Thresholds are the least
    scores that select with `precision` on the third of documents that the trees have not seen. A family without both
    kinds of candidate, or without such a score, selects nothing. None where no family is left.
    """
    picked = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `picked` has at most `sample` rows, so it can be sent to every executor.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id", "left_semi").where("text is not null and text rlike '[0-9@]'")

    def rewritten(by: tuple) -> Column:
        text = F.col("text")
        for pattern, to in zip((_EMAIL, _PHONE, _CARD, _IP), by):
            text = F.regexp_replace(text, F.lit(pattern), F.lit(to.replace("$ ", "\\$ ")))
        return text

    rows = rows.select("doc_id", F.explode(F.array("text", *map(rewritten, LOOSE + PLAIN))).alias("text"))
    # Outer, since for a plain explode the optimizer would copy all these expressions into a filter before it.
    found = stored(_with_candidates(_with_base(_prepared(rows)), _MARK).select("doc_id", F.explode_outer("candidates").alias("e")).where("e is not null"), "candidates")
    start, trees, threshold = {}, {}, {}
    for kind in PROPOSED:
        got = (found.where(F.col("e.family") == KINDS.index(kind)).select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("kept_back"), F.col("e.marked").alias("y"), F.col("e.f").alias("f"))
               .orderBy(F.xxhash64("f", "y"), "f").limit(candidates).collect())
        x, y, back = np.array([r["f"] for r in got]), np.array([r["y"] for r in got], float), np.array([r["kept_back"] for r in got], bool)
        if not len(y) or not 0 < y[~back].sum() < (~back).sum() or not back.any():
            continue
        start[kind], trees[kind] = grow(x[~back], y[~back], rounds, depth, rate)
        s = Boosted(start, trees, {}).score(kind, x[back])
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(y[back][order]) / np.arange(1, len(order) + 1)
        last = np.append(s[order][1:] != s[order][:-1], True)                 # rows of equal scores are selected together
        good = np.flatnonzero(last & (right >= precision))
        if len(good):
            threshold[kind] = float(s[order][good[-1]])
    kept = list(threshold)
    return Boosted({k: start[k] for k in kept}, {k: trees[k] for k in kept}, threshold) if kept else None


def _prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digits", F.expr("text rlike '[0-9]'"))


def find_personal_data(docs: DataFrame, model: Boosted | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The base kinds are counted and hashed; `spans` lists them and what the model selects of the candidates that overlap
    none of them (kinds handle, number, network). Selected spans may overlap each other; a redaction covers their union.

    Null and empty texts have no spans and the digest of the empty string; repeated rows are kept each; null ids stay
    null. Spans that start together are listed by kind, then by end. Very long texts are scanned whole, in time about in
    proportion to their length and matches. An empty table gives no rows. Further columns are not carried.
    """
    rows = _prepared(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = _with_candidates(_with_base(rows)) if model else _with_base(rows)
    base = F.array_sort(F.concat(*[F.expr(f"transform({k}, e -> named_struct('a', e.a, 'k', {i}, 'b', e.b))") for i, k in enumerate(BASE)]))
    rows = rows.withColumn("base", base)
    if model:
        chosen = " or ".join(f"(e.family = {KINDS.index(k)} and {model.sql(k)} >= {t!r}D)" for k, t in model.threshold.items())
        rows = rows.withColumn("added", F.expr(f"transform(filter(candidates, e -> {chosen}), e -> named_struct('a', e.a, 'k', e.family, 'b', e.b))"))
    else:
        rows = rows.withColumn("added", F.slice("base", 1, 0))
    names = f"array({', '.join(map(repr, KINDS))})"

    def joined(spans: str) -> Column:
        return F.expr(f"array_join(transform({spans}, e -> concat({names}[e.k], ':', e.a, ':', e.b)), ',')")

    return rows.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"),
                       joined("array_sort(concat(base, added))").alias("spans"), F.size("added").cast("bigint").alias("n_added"))
