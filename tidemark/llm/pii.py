"""Personal data: fixed patterns, and identifiers found by bootstrapped context patterns.

Base spans are the leftmost non-overlapping matches of four fixed patterns, checked (parts of an address, Luhn
sum, number of digits) and dropped where the check fails. A bootstrap adds to them:

* its seed entities are the base spans and tokens that only a secret looks like (``secret_shape``: long
  hexadecimal strings, UUIDs, long mixes of capitals, small letters and digits); every other token with a digit,
  of MIN_ID characters or more, is an unlabelled instance;
* the words before and after an entity make its lexical patterns: the two words before, the word before with the
  word after, and a label directly before (a word followed by ``:``, ``=`` or ``#``). White space, quotes,
  brackets and other punctuation next to the entity are skipped; words are taken whole, however long, but end where
  a neighbouring entity does;
* Spark scores the pattern-instance graph in rounds until one adds no pattern. A pattern's score is the share of
  its distinct instances that are trusted, each by its own score, times log2(1 + trusted instances) /
  log2(1 + MIN_SUPPORT) up to 1; an instance's score is that of its best pattern, seeds have 1;
* a pattern of at least CONFIDENCE with at least MIN_SUPPORT distinct trusted instances (seeds, and those with a
  pattern accepted in an earlier round) is accepted, and its instances become spans of kind ``id``. A secret's
  shape alone makes no span. Base spans always stay; an added span never overlaps one.

Counts are taken over all documents. Repeated texts count once for each distinct entity string, so a group of
copies can't make a pattern. Edges are aggregated before they are shuffled, so a hot pattern or entity arrives as
its distinct partners only.

Defined cases: null text counts as empty; rows may repeat, each is judged by itself; other columns are ignored;
an empty table gives no rows. All scans of a text take time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The bootstrap: rounds (None: until no pattern is added), least confidence, distinct trusted instances, least length
#: of an identifier.
ROUNDS, CONFIDENCE, MIN_SUPPORT, MIN_ID = None, 0.8, 5, 6
#: Accepted patterns up to this number go to every executor; beyond it the join is shuffled.
BROADCAST_PATTERNS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# No match can begin inside a run of digits if none begins with the run, so only its start is tried.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile(r"[0-9]").search
_digit_on = re.compile(r"[0-9]\S*").finditer
_word = re.compile(r"\S+").finditer
_hex = re.compile(r"[0-9a-fA-F]{32,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}").fullmatch
_mixed = re.compile(r"[A-Za-z0-9_+/=-]{24,}").fullmatch
_EDGE = ".,;:!?()[]{}<>\"'|*&%$#"
#: Characters of a context word beyond which patterns hold its digest.
LONG_WORD = 100
#: What may stand between an entity and its context words, besides white space.
_SKIP = frozenset(_EDGE + "=`“”„‘’«»")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern; each can only end the run of local characters before an ``@``."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    if _digit(text):
        for m in _ip(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _phone(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return found


def secret_shape(token: str) -> bool:
    """Whether a token looks like a key or digest and like nothing else."""
    digits = sum("0" <= c <= "9" for c in token)
    if _hex(token):
        return digits >= 4 and len(token) - digits >= 4
    return bool(_mixed(token)) and digits >= 3 and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)


class Contexts:
    """Lexical patterns of the entities of one text, whose spans are given.

    A context word is what white space and the ends of entities cut out of the text, so each part of a text is in the
    context of a few entities only, and a long word is read once: patterns name it by its digest.
    """

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text, self.bounds, self.short = text, sorted({x for span in spans for x in span}), {}
        self.tokens = [m.span() for m in _word(text)]
        self.token_starts = [a for a, _ in self.tokens]
        kept = ((a, b, text[a:b]) for a, b in self.tokens)
        stripped = ((a + len(w) - len(w.lstrip(_EDGE)), b - len(w) + len(w.rstrip(_EDGE))) for a, b, w in kept)
        self.words = [(a, b) for a, b in stripped if a < b]
        self.starts = [a for a, _ in self.words]

    def _named(self, start: int, stop: int) -> str:
        if stop - start <= LONG_WORD:
            return self.text[start:stop].strip(_EDGE).lower()
        if (start, stop) not in self.short:
            word = self.text[start:stop].strip(_EDGE).lower()
            self.short[start, stop] = word if len(word) <= LONG_WORD else f"{_key(word)}"
        return self.short[start, stop]

    def __call__(self, start: int, end: int) -> list[str]:
        text, bounds, at, stop = self.text, self.bounds, start, end
        while at and (text[at - 1] in _SKIP or text[at - 1].isspace()):
            at -= 1
        while stop < len(text) and (text[stop] in _SKIP or text[stop].isspace()):
            stop += 1
        before, k = [], bisect_left(self.starts, at) - 1
        if k >= 0 and self.words[k][1] >= at:  # the rest of a word that ends here
            floor = bisect_left(bounds, at) - 1
            before = [w for w in [self._named(max(self.starts[k], bounds[floor] if floor >= 0 else 0), at)] if w]
            k -= 1
        while k >= 0 and len(before) < 2:
            before.append(self._named(*self.words[k]))
            k -= 1
        out = []
        if len(before) == 2:
            out.append(f"b2 {before[1]} {before[0]}")
        if before and stop < len(text):
            close, ceiling = self.tokens[bisect_right(self.token_starts, stop) - 1][1], bisect_right(bounds, stop)
            after = self._named(stop, min(close, bounds[ceiling] if ceiling < len(bounds) else close))
            if after:
                out.append(f"ba {before[0]} | {after}")
        if before and any(c in ":=#" for c in text[at:start]):
            out.append(f"lb {before[0]}")
        return out


def _contexts(text: str, start: int, end: int) -> list[str]:
    return Contexts(text, [(start, end)])(start, end)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that overlap no base span."""
    if not _digit(text):
        return []
    out, taken, k, free = [], sorted((a, b) for _, a, b in base), 0, 0
    for m in _digit_on(text):
        start = m.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        free = m.end()
        word = text[start:free]
        a = start + len(word) - len(word.lstrip(_EDGE))
        b = start + len(word.rstrip(_EDGE))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= MIN_ID and not any(x < b and a < y for x, y in taken[k : k + 4]):
            out.append((a, b))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end), found (candidates' start, end, entity, seed, patterns), seeds (entity, patterns).

    Entities are 64-bit digests of the matched string, patterns of the context.
    """

    def make():
        def f(ids, texts):
            bases, founds, seeds = [], [], []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                found = candidates(t, base)
                contexts = Contexts(t, [x[1:] for x in base] + found) if base or found else None
                bases.append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
                founds.append([{"start": a, "stop": b, "entity": _key(t[a:b].lower()), "seed": int(secret_shape(t[a:b])), "patterns": [_key(c) for c in contexts(a, b)]} for a, b in found])
                seeds.append([{"entity": _key(t[a:b].lower()), "patterns": [_key(c) for c in contexts(a, b)]} for _, a, b in base])
            return [ids, bases, founds, seeds]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, base array<struct<kind:string,start:int,stop:int>>, found array<struct<start:int,stop:int,entity:bigint,seed:int,patterns:array<bigint>>>, seeds array<struct<entity:bigint,patterns:array<bigint>>>"
    return common.arrow_map(docs.select("doc_id", "text"), make, schema)


def patterns(scanned: DataFrame, rounds: int | None = ROUNDS, confidence: float = CONFIDENCE, support: int = MIN_SUPPORT) -> DataFrame:
    """pattern, score of the accepted patterns."""
    edge = lambda column, seed: scanned.select(F.explode(column).alias("x")).select("x.entity", F.explode("x.patterns").alias("pattern"), seed.alias("seed"))
    # A hot pattern or entity collapses in the partial aggregate before it is shuffled.
    graph = common.materialize(edge("seeds", F.lit(1)).unionByName(edge("found", F.col("x.seed"))).groupBy("pattern", "entity").agg(F.max("seed").alias("seed")), "pii-graph")
    accepted, known, done = None, 0, 0
    while rounds is None or done < rounds:
        weighed, trust = graph, F.col("seed").cast("double")
        if known:
            near = F.broadcast if known <= BROADCAST_PATTERNS else (lambda d: d)
            instance = graph.join(near(accepted), "pattern").groupBy("entity").agg(F.max("score").alias("own"))
            weighed = graph.join(instance, "entity", "left")
            trust = F.greatest(trust, F.coalesce("own", F.lit(0.0)))
        sums = weighed.groupBy("pattern").agg(F.sum(trust).alias("trusted"), F.count("*").alias("n"), F.sum((trust > 0).cast("long")).alias("instances"))
        enough = F.least(F.lit(1.0), F.log2(1 + F.col("trusted")) / F.log2(F.lit(1.0 + support)))
        scores = sums.where(f"instances >= {int(support)}").select("pattern", (F.col("trusted") / F.col("n") * enough).alias("score"))
        accepted = common.materialize(scores.where(F.col("score") >= confidence), "pii-scores")
        before, known, done = known, accepted.count(), done + 1
        if known <= before:
            break
    return accepted


def find(docs: DataFrame, rounds: int | None = ROUNDS, confidence: float = CONFIDENCE, support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id, base, added: for each row of ``docs`` its base spans and the added ones (arrays of kind, start, stop)."""
    scanned = common.materialize(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    accepted = patterns(scanned, rounds, confidence, support)
    near = F.broadcast if accepted.count() <= BROADCAST_PATTERNS else (lambda d: d)
    hits = scanned.where("size(found) > 0").select("row", F.explode("found").alias("x")).select("row", "x.start", "x.stop", F.explode("x.patterns").alias("pattern")).join(near(accepted), "pattern")
    spans = hits.select("row", "start", "stop").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "stop"))).alias("added"))
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return scanned.join(spans, "row", "left").select("row", "doc_id", "base", F.coalesce("added", empty).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added, n_spans (all)."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop, kind])
    for start, stop, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = stop
    return "".join([*out, text[at:]])


def _key(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def redacted(docs: DataFrame, rounds: int | None = ROUNDS, confidence: float = CONFIDENCE, support: int = MIN_SUPPORT) -> DataFrame:
    """``docs`` with its spans replaced in ``text``; ``n_chars`` (if there is one) follows a changed text.

    Texts aren't shuffled or stored: with the accepted patterns known (BROADCAST_PATTERNS of them at most go to the
    executors; with more the texts are joined with their spans) spans are found again while they are replaced.
    """
    scanned = common.materialize(scan(docs).select("base", "found", "seeds"), "pii-spans")
    accepted = patterns(scanned, rounds, confidence, support)
    if accepted.count() > BROADCAST_PATTERNS:
        return _redacted_by_join(docs, rounds, confidence, support)
    trusted = docs.sparkSession.sparkContext.broadcast({r["pattern"] for r in accepted.select("pattern").collect()})

    counted = "n_chars" in docs.columns

    def make():
        known = trusted.value

        def one(t):
            if not t:
                return t
            base = base_spans(t)
            found = candidates(t, base) if known else []
            contexts = Contexts(t, [x[1:] for x in base] + found) if found else None
            added = [("id", a, b) for a, b in found if any(_key(c) in known for c in contexts(a, b))]
            return redact(t, base + added) if base or added else t

        def f(batch):
            old = batch.column("text").to_pylist()
            new = list(map(one, old))
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if counted:
                at = batch.schema.get_field_index("n_chars")
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(at).to_pylist(), old, new)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            return batch

        return f

    return common.batch_map(docs, make)


def _redacted_by_join(docs: DataFrame, rounds: int | None, confidence: float, support: int) -> DataFrame:
    kept = common.materialize(common.numbered(docs), "pii-docs")
    found = find(kept.select(F.col("row").alias("doc_id"), "given.text"), rounds, confidence, support).select(F.col("doc_id").alias("row"), F.concat("base", "added").alias("spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else redact(t, [(s["kind"], s["start"], s["stop"]) for s in ss]) for t, ss in zip(texts, spans)], dtype=object)

    changed = kept.join(found, "row").select("given", cut("given.text", "spans").alias("new"))
    columns = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("new").eqNullSafe(F.col("given.text")), F.col("given.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[columns[c].alias(c) if c in columns else F.col("given").getField(c).alias(c) for c in docs.columns])


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text or "")).encode()).hexdigest()
