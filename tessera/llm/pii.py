"""Personal data: patterns propose spans, checks confirm them, context words adjust a score.

DataFrame functions only. A pattern's matches and the pieces of text between
them come from the same regular expression, so the pieces' lengths give the
matches' places in code points. Loops in the patterns are possessive and starts
are tied to the beginning of a run, so that long runs of one kind of character
cost time in proportion to their length.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3


@dataclasses.dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str  # words that raise the score, as a pattern
    needs: str = ""  # a text without it has no match


_SECRET = "A-Za-z0-9+/_.=-"
_SECRET_NAMES = r"(?i:api[_-]?key|access[_-]?key|secret|secret[_-]?key|token|password|passwd|pwd)"
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Base kinds in the order in which they are listed, then added ones.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"\b(e-?mail|contact|write|correo|courriel)", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\b(ip|host|server|address|login)\b", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", 0.7, r"\b(card|visa|credit|debit|mastercard|tarjeta|carte|karte)"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"\b(phone|call|tel|mobile|fax|whatsapp|telefon|llame)", "+"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", 0.8, r"\b(iban|account|bank|konto|cuenta|compte)"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, r"\b(ssn|social security)", "-"),
    # the value that is given to a name such as token or password
    Kind("secret", rf"(?<![{_SECRET}])(?=[{_SECRET}]{{16}})(?<={_SECRET_NAMES}[\"']?\x20{{0,2}}[:=]\x20{{0,2}}[\"']?)[{_SECRET}]{{16,512}}+", 0.7, r"\b(secret|private|credential|key)"),
    # forms that issuers have published for their keys
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,200}+|sk_live_[A-Za-z0-9]{24,200}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,2000}+\.eyJ[A-Za-z0-9_-]{10,4000}+\.[A-Za-z0-9_-]{10,2000}+)|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----", 0.9, r"\b(secret|private|credential|key)"),
    Kind("ipv6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])", 0.6, r"\b(ip|host|server|address|login)\b", ":"),
    Kind("dni", r"(?<![0-9A-Za-z])[0-9]{8}-?[A-Z](?![0-9A-Za-z])", 0.6, r"\b(dni|nif|identidad)\b"),
    Kind("nir", r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])", 0.6, r"\b(nir|s[eé]curit[eé] sociale|insee)"),
)
KINDS = BASE + ADDED
#: Added kinds count from this score on; base ones always do.
MIN_SCORE = 0.5


def _mod97(value: Column) -> Column:
    """The remainder that must be 1: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest, c):
        letter = F.ascii(c) >= 65
        return (rest * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(F.length(c) == 1, step(rest, c)).otherwise(rest))


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (_mod97(value) == 1)
    if kind == "secret":  # no word, and no run of few characters
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) > 8)
    if kind == "ipv6":
        short = value.rlike("^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?$") & value.rlike("[0-9A-Fa-f]")
        groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
        return value.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$") | (short & (groups <= 7))
    if kind == "dni":
        return F.substring(value, -1, 1) == F.lit(_DNI_LETTERS).substr((F.substring(value, 1, 8).cast("int") % 23 + 1).cast("int"), F.lit(1))
    if kind == "nir":
        plain = F.regexp_replace(value, " ", "")
        return F.lit(97) - F.substring(plain, 1, 13).cast("long") % 97 == F.substring(plain, 14, 2).cast("long")
    return F.lit(True)


def _items(found: Column, between: Column) -> Column:
    """(gap, size, value, tail) of each match: the code points between it and the last one, its own, its text, and what stands right before it."""

    def one(value, gap):
        return F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), value.alias("value"), F.right(gap, F.lit(CONTEXT_CHARS)).alias("tail"))

    return F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), one)


def _blocks(items: Column) -> Column:
    """The matches in blocks of about the root of their number, with places within the block.

    An array that grows by one is copied each time; in blocks that costs the
    number of matches times its root.
    """
    width = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,near:string>>").alias("spans"))

    def block(b):
        def step(state, item):
            start = state["at"] + item["gap"]
            span = F.struct(start.alias("start"), (start + item["size"]).alias("end"), item["value"].alias("value"), item["near"].alias("near"))
            return F.struct((start + item["size"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.aggregate(F.slice(items, b * width + 1, width), zero, step)

    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int")), block)).otherwise(F.array().cast("array<struct<at:int,spans:array<struct<start:int,end:int,value:string,near:string>>>>"))


def _places(blocks: Column) -> Column:
    """(start, end, value, near) of each match."""
    begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))

    def moved(b, by):
        return F.transform(b["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"), s["near"].alias("near")))

    return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), moved))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id and spans, an array of (start, kind_no, end, kind, value, score) by start, then kind.

    start and end are code points, end exclusive. Spans of one kind don't
    overlap; those of different kinds may. Context words count in the
    CONTEXT_CHARS code points before a match. Whole texts are searched; a null or
    empty text has no spans. A null id stays null, repeated rows are searched
    alike, other columns are left out, an empty table gives no rows.
    """
    text = F.col("_text")
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    found = {}
    for kind in kinds:
        matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        found[f"_m_{kind.name}"] = F.when(F.contains(text, F.lit(kind.needs)), matches).otherwise(none) if kind.needs else matches
    frame = frame.withColumns(found)
    between = {f"_b_{k.name}": F.when(F.size(f"_m_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none) for k in kinds}
    frame = frame.withColumns(between)
    frame = frame.withColumns({f"_z_{k.name}": _items(F.col(f"_m_{k.name}"), F.col(f"_b_{k.name}")) for k in kinds})

    def with_context(items: Column) -> Column:
        """What stands before each match, back to the end of the second match before it, in lower case."""

        def one(item, i):
            last = F.get(items, i - 1)
            near = F.lower(F.right(F.concat(F.coalesce(last["tail"], F.lit("")), F.coalesce(last["value"], F.lit("")), item["tail"]), F.lit(CONTEXT_CHARS)))
            return F.struct(item["gap"].alias("gap"), item["size"].alias("size"), item["value"].alias("value"), near.alias("near"))

        return F.when(F.size(items) > 0, F.transform(items, one)).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string,near:string>>"))

    frame = frame.withColumns({f"_i_{k.name}": with_context(F.col(f"_z_{k.name}")) for k in kinds})
    frame = frame.withColumns({f"_k_{k.name}": _blocks(F.col(f"_i_{k.name}")) for k in kinds})
    frame = frame.withColumns({f"_p_{k.name}": _places(F.col(f"_k_{k.name}")) for k in kinds})

    def scored(kind: Kind, number: int) -> Column:
        def one(span):
            score = F.when(span["near"].rlike(kind.context), F.lit(min(1.0, kind.score + CONTEXT_BONUS))).otherwise(F.lit(kind.score))
            return F.struct(span["start"].alias("start"), F.lit(number).alias("kind_no"), span["end"].alias("end"), F.lit(kind.name).alias("kind"), span["value"].alias("value"), score.alias("score"))

        kept = F.transform(F.filter(F.col(f"_p_{kind.name}"), lambda s: _confirmed(kind.name, s["value"])), one)
        return kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= min_score)

    spans = F.array_sort(F.concat(*[scored(k, i) for i, k in enumerate(kinds)]))
    return frame.select("doc_id", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with each span of find_pii() replaced by [kind]; of overlapping spans the first counts."""
    spans = find_pii(docs, id_col, text_col).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    both = texts.dropDuplicates(["doc_id", "text"]).join(spans.dropDuplicates(["_id", "spans"]), F.col("doc_id").eqNullSafe(F.col("_id")))

    def step(state, s):
        cut = F.concat(state["out"], F.col("text").substr(state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        fresh = F.struct(s["end"].alias("at"), cut.alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(state)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate("spans", zero, step, lambda state: F.concat(state["out"], F.col("text").substr(state["at"] + 1, F.length("text"))))
    return both.select("doc_id", end.alias("text"))
