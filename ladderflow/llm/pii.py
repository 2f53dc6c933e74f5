"""Personal data by bootstrapped contextual extraction.

1. Seeds: every whole text is searched for e-mail addresses, IP addresses, card numbers and phone numbers in their
   strict forms (the base spans). Candidates are all other identifiers: runs of at least four digits, codes of letters and
   digits around such a run, and addresses that miss the strict form.
2. The words beside an instance are its lexical patterns: one or two words to the left, one or two to the right, and the
   words of both sides together. Patterns and instances form a graph.
3. Spark scores the graph in rounds. Of a pattern with at least ``min_support`` known instances, the confidence for a kind is
   ``pos / (1 + pos + unknown / 3 + other)`` over the occurrences in its slot: pos is the summed score of known instances,
   unknown those whose form would fit the kind, other the rest. A candidate's score is the noisy-or of its patterns, each
   weighed by its share of the candidate's occurrences, so that a frequent number is not known by one good place.
4. Candidates of at least ``min_score`` (``odd_score`` if their form does not fit the kind) are promoted: they are known
   instances of the next round and induce patterns of their own. Rounds end when the promoted set stands still, or comes back to
   one that was there before.
5. Promoted candidates are the additional spans, wherever they stand. Base spans always stay.

Joins carry only patterns of some confidence and promoted candidates; both are broadcast only if measured to be small.

Defined results: null text is the empty text, without spans. Additional spans never overlap base spans or each other.
Repeated rows give repeated results; a null doc_id is kept; extra columns of any name are kept by redact() and ignored by
find(). Of kinds of equal score the first listed counts. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderflow.llm.common import discard, materialize, small, texts, whole_row

KINDS = ("email", "ip", "card", "phone")
#: The strict forms.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never begins within digits: what fails from the first of them fails from the others too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every match of the last three lies in one such run.
RUN = re.compile(r"[0-9+][0-9+().\x20-]*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOOSE = re.compile(r"@[A-Za-z0-9-]+")
VEILED = re.compile(r" ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]+)*", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ on: linear in the text."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            low = m.end()
        at = text.find("@", max(low, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict forms, sorted by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for run in RUN.finditer(text):
        part, at = run.group(), run.start()
        if len(part) < 7:
            continue
        for m in IP.finditer(part):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((at + m.start(), 1, at + m.end()))
        for m in CARD.finditer(part):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((at + m.start(), 2, at + m.end()))
        for m in PHONE.finditer(part):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((at + m.start(), 3, at + m.end()))
    return sorted(out)


def fits(part: str) -> int:
    """Kinds (bit k for KINDS[k]) whose form a run of digits and separators would fit."""
    digits = sum(c.isdigit() for c in part)
    groups = part.split(".")
    if len(groups) >= 4 and all(g.isdigit() for g in groups):
        return 1 << 1
    return (1 << 2) * (12 <= digits <= 19) + (1 << 3) * (7 <= digits <= 15)


def before(text: str, rest: re.Pattern) -> list[tuple[int, int, int]]:
    """Loose addresses, found from each match of what follows the name on: linear in the text."""
    out, low = [], 0
    for m in rest.finditer(text):
        begin = m.start()
        while begin > low and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < m.start():
            out.append((begin, m.end(), 1))
            low = m.end()
    return out


def glued(text: str, at: int) -> bool:
    """Whether an ASCII letter or digit stands there."""
    return 0 <= at < len(text) and text[at].isalnum() and text[at].isascii()


def numbers(text: str) -> list[tuple[int, int, int]]:
    """Runs of at least four digits, and codes: such a run with the letters that it is glued to. A run that begins or ends within a
    word is cut at its first or last blank there, so a word before a number ("gate2 555 1234") does not swallow it."""
    found, covered = [], 0
    for run in RUN.finditer(text):
        pieces = [(run.start(), run.start() + len(run.group().rstrip("+().- ")))]
        begin, end = pieces[0]
        if glued(text, begin - 1) and (cut := text.find(" ", begin, end)) >= 0:
            pieces = [(begin, cut), (cut + 1, end)]
        begin, end = pieces[-1]
        if end == run.end() and glued(text, end) and (cut := text.rfind(" ", begin, end)) >= 0:
            pieces = [*pieces[:-1], (begin, cut), (cut + 1, end)]
        for begin, end in pieces:
            begin += len(part := text[begin:end]) - len(part.lstrip("().- "))
            end = begin + len(part := text[begin:end].rstrip("+().- "))
            if begin < covered or sum(c.isdigit() for c in part) < 4:
                continue
            kinds = None
            while begin > covered and glued(text, begin - 1):
                begin, kinds = begin - 1, 0
            while glued(text, end):
                end, kinds = end + 1, 0
            found.append((begin, end, fits(part) if kinds is None else kinds))
            covered = end
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, fitting kinds) of identifiers that overlap no base span and none of each other: from the left, the longest."""
    found = []
    if "@" in text:
        found += before(text, LOOSE)
    low = text.lower()
    if "at]" in low or "at)" in low or "at ]" in low or "at )" in low:
        found += before(text, VEILED)
    found += numbers(text)
    taken = sorted((x, y) for x, _, y in base)
    out, i, last = [], 0, 0
    for begin, end, kinds in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= begin:
            i += 1
        if begin >= last and not any(x < end and y > begin for x, y in taken[max(0, i - 4) : i + 4]):
            out.append((begin, end, kinds))
            last = end
    return out


def patterns(text: str, begin: int, end: int, window: int = 48) -> list[int]:
    """Signed 64-bit hashes of the patterns beside a span: none for a side at the edge of the text."""
    import xxhash

    left = text[max(0, begin - window) : begin].lower().split()[-2:]
    right = text[end : end + window].lower().split()[:2]
    named = [("L", left[-1:]), ("LL", left if len(left) > 1 else []), ("R", right[:1]), ("RR", right if len(right) > 1 else []), ("LR", left[-1:] + right[:1] if left and right else [])]
    hashes = (xxhash.xxh3_64_intdigest(" ".join([side, *words]).encode("utf-8", "surrogatepass")) for side, words in named if words)
    return [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]


SPAN = "struct<s:int,k:int,e:int>"
#: k: the kind of a seed, -1 of a candidate; fits: the kinds whose form it would fit, one bit each.
INSTANCE = "struct<s:int,k:int,e:int,fits:int,value:bigint,patterns:array<bigint>>"
FOUND = f"doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, inst array<{INSTANCE}>"
_SPAN = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])
_INSTANCE = pa.struct([*_SPAN, ("fits", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def joined(spans) -> str:
    """kind:start:end of each, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates of a text, as rows of INSTANCE."""
    spans = [(s, k, e, 1 << k) for s, k, e in base] + [(s, -1, e, kinds) for s, e, kinds in candidates(text, base)]
    value = lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return [{"s": s, "k": k, "e": e, "fits": kinds, "value": value(text[s:e]), "patterns": patterns(text, s, e)} for s, k, e, kinds in spans]


def _search(batches):
    for b in batches:
        columns: list[list] = [[] for _ in range(7)]
        for text in b.column("text").to_pylist():
            base = base_spans(text)
            count = Counter(k for _, k, _ in base)
            row = [*(count[k] for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), [{"s": s, "k": k, "e": e} for s, k, e in base], instances(text, base)]
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(_SPAN), pa.list_(_INSTANCE)]
        names = ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "inst"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)


def find(df: DataFrame, rounds: int | None = None, min_support: int = 3, min_score: float = 0.6, odd_score: float = 0.9) -> DataFrame:
    """doc_id, text_key, base counts and digest, base and added array<struct<s, k, e>> of every document."""
    docs = texts(df, "doc_id")
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_search, FOUND)
    found = materialize(found, "pii-base")
    added = _bootstrap(found, rounds, min_support, min_score, odd_score)
    none = F.array().cast(f"array<{SPAN}>")
    base = found.drop("inst")
    if added is None:
        return base.withColumn("added", none)
    same = (base["doc_id"].eqNullSafe(added["doc_id"])) & (base["text_key"] == added["text_key"])
    return base.join(small(added, elements="added"), same, "left").select(*(base[c] for c in base.columns), F.coalesce(added["added"], none).alias("added"))


def _bit(mask: Column, k: Column) -> Column:
    """Whether bit k of mask is set."""
    return F.get(F.array(*(mask.bitwiseAND(1 << x) != 0 for x in range(len(KINDS)))), k)


def promoted(inst: DataFrame, rounds: int | None, min_support: int, min_score: float, odd_score: float) -> DataFrame | None:
    """(value, k, score) of the promoted candidates, a written table; None if there are none. inst: rows of INSTANCE. Rounds go on
    until the promoted set stands still or is one that was there before (or, if given, for so many rounds)."""
    edges = inst.select("value", "k", "fits", F.explode("patterns").alias("p")).groupBy("p", "value", "k", "fits").agg(F.count("*").alias("n"))
    totals = inst.where("k < 0").groupBy("value").agg(F.count("*").alias("places"))
    by_kind = [F.sum(F.when(F.col("fits").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)).alias(f"fits{k}") for k in range(4)]
    seeds = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"pos{k}") for k in range(4)] + [F.sum((F.col("k") == k).cast("int")).alias(f"known{k}") for k in range(4)]
    edges = materialize(edges, "pii-edges")
    stats = edges.groupBy("p").agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.sum((F.col("k") < 0).cast("int")).alias("open"), *by_kind, *seeds)
    # a pattern matters only with enough instances, and with candidates to promote
    stats = materialize(stats.where((F.col("values") >= min_support) & (F.col("open") > 0)), "pii-patterns")
    if stats.isEmpty():
        discard(edges, stats)
        return None
    open_edges = edges.where("k < 0").join(small(stats.select("p")), "p", "left_semi").join(totals, "value").select("p", "value", "fits", "n", "places")
    open_edges = materialize(open_edges, "pii-open")
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"fits{k}").alias("fitting"), F.col(f"pos{k}").cast("double").alias("pos"), F.col(f"known{k}").alias("known")) for k in range(4)))
    slots = stats.select("p", "n", F.explode(kinds).alias("x")).select("p", "n", "x.*")
    best, sets, n = None, [(0, None)], 0
    while rounds is None or n < rounds:
        n += 1
        known = slots.withColumn("seen", F.col("pos"))  # occurrences of known instances that fit
        if best is not None:
            more = open_edges.join(small(best.select("value", "k", "score")), "value").groupBy("p", "k").agg(
                F.sum(F.col("score") * F.col("n")).alias("more"), F.count("*").alias("ones"), F.sum(F.when(_bit(F.col("fits"), F.col("k")), F.col("n")).otherwise(0)).alias("fit"))
            known = known.join(more, ["p", "k"], "left").fillna(0, ["more", "ones", "fit"])
            known = known.select("p", "n", "k", "fitting", (F.col("pos") + F.col("more")).alias("pos"), (F.col("known") + F.col("ones")).alias("known"), (F.col("seen") + F.col("fit")).alias("seen"))
        unknown = F.greatest(F.col("fitting") - F.col("seen"), F.lit(0))
        confidence = F.col("pos") / (1 + F.col("pos") + unknown / 3 + (F.col("n") - F.col("fitting")))
        sure = known.where(F.col("known") >= min_support).select("p", "k", F.least(confidence, F.lit(0.99)).alias("confidence")).where("confidence >= 0.1")
        sure = materialize(sure, "pii-confidence")
        scored = open_edges.join(small(sure), "p").groupBy("value", "k").agg(F.max("fits").alias("fits"), F.sum(F.log1p(-F.col("confidence")) * F.col("n") / F.col("places")).alias("doubt"))
        scored = scored.select("value", "k", (1 - F.exp("doubt")).alias("score"), F.when(_bit(F.col("fits"), F.col("k")), min_score).otherwise(odd_score).alias("least")).where("score >= least")
        before, best = best, materialize(scored.groupBy("value").agg(F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("x")).select("value", "x.*"), "pii-promoted")
        discard(sure, *([before] if before is not None else []))
        now = tuple(best.agg(F.count("*"), F.sum(F.xxhash64("value", "k").cast("decimal(38,0)"))).first())
        if now in sets:
            break
        sets.append(now)
    discard(edges, stats, open_edges)
    return best if best is not None and not best.isEmpty() else None


def _bootstrap(found: DataFrame, rounds: int | None, min_support: int, min_score: float, odd_score: float) -> DataFrame | None:
    """doc_id, text_key, added spans of the documents that have any; None if nothing is promoted."""
    inst = found.select("doc_id", "text_key", F.explode("inst").alias("i")).select("doc_id", "text_key", "i.*")
    best = promoted(inst, rounds, min_support, min_score, odd_score)
    if best is None:
        return None
    chosen = inst.where("k < 0").drop("k").join(small(best), "value")
    spans = chosen.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("s", "k", "e"))).alias("added"))
    return materialize(spans, "pii-added")


def all_spans() -> Column:
    """Base and added spans together, sorted."""
    return F.array_sort(F.concat("base", "added"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from find()."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.array_join(F.transform(all_spans(), text), ",").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all columns stay, n_chars follows."""
    spans = find(docs).where("size(base) + size(added) > 0").select(F.col("doc_id").alias("of"), "text_key", all_spans().alias("spans")).dropDuplicates(["of", "text_key"])
    spans = materialize(spans, "pii-spans")
    keyed = whole_row(docs).withColumn("key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("of")) & (F.col("key") == F.col("text_key"))
    both = keyed.join(small(spans, elements="spans"), same, "left").select("row", "spans")
    text = F.col("row.text")
    # pieces of the text between spans: begin of each piece is the end of the one before
    clean = F.aggregate(
        "spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["s"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["done"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), x["k"]), F.lit(">")).alias("done"),
            x["e"].alias("at"),
        )),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    new = F.col("row").withField("text", clean)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    return both.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(new).alias("row")).select("row.*")
