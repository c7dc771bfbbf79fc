"""Documents from records: call documents, chats with scored segments, tokens with labels, preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

#: Label of a token that isn't scored. Fixed value.
IGNORE = -100
#: Special tokens in their order; ids follow those of the 256 bytes. Fixed values.
SPECIAL = ("<tool>", "</tool>", "<response>", "</response>", "<call>", "</call>", "<state>", "</state>", "<memory>", "</memory>", "<think>", "</think>", "<|im_start|>", "<|im_end|>")
#: Ids of the end, the beginning and the padding of a sequence, which a tokenizer has besides. The byte tokenizer puts them behind the special tokens.
END, BEGIN, PAD = (256 + len(SPECIAL) + i for i in range(3))


def call_document(query: Column, tools: Column, answers: Column) -> Column:
    """A flat call document; tools and answers are put in as they are written, byte for byte."""
    return F.concat(F.lit("Tools: "), tools, F.lit("\n\nQuery: "), query, F.lit("\n\nCalls: "), answers)


def chat_document(system: Column, chat: Column) -> Column:
    """The system text, an empty line and the chat; only the chat without a system text, null without a chat."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(chat), None).when(blank(system), strip(chat)).otherwise(F.concat(strip(system), F.lit("\n\n"), strip(chat)))


def memory_block(recent: Column) -> Column:
    """Remembered lines, numbered from 1."""
    return F.array_join(F.transform(recent, lambda r, i: F.concat(F.lit(" "), (i + 1).cast("string"), F.lit(". "), r)), "\n")


def segments(turns: Column, system: Column, state: Column) -> Column:
    """``array<struct<text, scored>>``: the system block with its state, then a segment per turn; assistant turns are scored."""

    def one(t):
        said = F.concat(F.lit("<think>"), F.coalesce(t["think"], F.lit("")), F.lit("</think><response>"), F.coalesce(t["calls"], F.lit("")), F.lit("</response>"))
        body = F.when(t["role"] == "assistant", said).otherwise(F.coalesce(t["text"], t["result"], F.lit("")))
        return F.struct(F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), body, F.lit("\n")).alias("text"), (t["role"] == "assistant").alias("scored"))

    held = F.coalesce(F.concat(F.lit("\n<state>"), state, F.lit("</state>")), F.lit(""))
    head = F.struct(F.concat(F.lit("<|system|>\n"), F.coalesce(system, F.lit("")), held, F.lit("\n")).alias("text"), F.lit(False).alias("scored"))
    return F.concat(F.array(head), F.transform(turns, one))


def joined(parts: Column) -> Column:
    """The whole document."""
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def record_example(turns: Column, memory: Column) -> Column:
    """A checked record as an example: ``struct<user, thinks, calls, results, memory>``, texts stripped, memory numbered lines or null where nothing is remembered."""
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    of = lambda field, rows: F.transform(rows, lambda t: t[field])
    m = F.from_json(memory, "struct<recent:array<string>,last_results:array<string>>")
    lines = F.concat(F.coalesce(m["recent"], F.array()), F.coalesce(m["last_results"], F.array()))
    user = F.get(F.filter(turns, lambda t: t["role"] == "user"), F.lit(0))["text"]
    return F.struct(
        strip(user).alias("user"),
        F.transform(of("think", said), strip).alias("thinks"),
        of("calls", said).alias("calls"),
        of("result", F.filter(turns, lambda t: t["role"] == "tool")).alias("results"),
        F.when(F.size(lines) > 0, memory_block(lines)).alias("memory"),
    )


def first_calls_of(turns: Column) -> Column:
    """The calls of the first assistant turn: what a reply is expected to be."""
    return F.get(F.filter(turns, lambda t: t["role"] == "assistant"), F.lit(0))["calls"]


def turn_signature(turns: Column) -> Column:
    """The user's text and the names of all calls in order: a light key for turns that ask the same and call the same."""
    user = F.get(F.filter(turns, lambda t: t["role"] == "user"), F.lit(0))["text"]
    names = F.flatten(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.coalesce(F.transform(F.from_json(t["calls"], "array<struct<name:string>>"), lambda c: F.coalesce(c["name"], F.lit("None"))), F.array())))
    return F.concat(strip(F.coalesce(user, F.lit(""))), F.lit(" || "), F.array_join(names, " "))


def scored_share(parts: Column) -> Column:
    """Bytes of the scored segments by bytes of all; null for an empty document."""
    size = lambda keep: F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, s: a + F.when(keep(s), F.octet_length(s["text"])).otherwise(0))
    return F.try_divide(size(lambda s: s["scored"]).cast("double"), size(lambda s: F.lit(True)))


def changed_lines(a: Column, b: Column) -> Column:
    """Numbers, from 1, of the lines in which two texts differ; lines that only one has count."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    n = F.greatest(F.size(x), F.size(y))
    return F.filter(F.sequence(F.lit(1), n), lambda i: ~F.get(x, i - 1).eqNullSafe(F.get(y, i - 1)))


def prompt(parts: Column) -> Column:
    """The document up to the first scored segment."""
    ends = F.array_position(F.transform(parts, lambda s: s["scored"]), True)
    return joined(F.when(ends > 0, F.slice(parts, F.lit(1), (ends - 1).cast("int"))).otherwise(parts))


def byte_tokens(text: Column) -> Column:
    """One token for each UTF-8 byte, in the JVM: the default tokenizer."""
    h = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def labelled(parts: Column) -> Column:
    """``struct<ids, labels>`` of segments: labels are the ids where a segment is scored, else IGNORE."""
    each = F.transform(parts, lambda s: byte_tokens(s["text"]))
    label = F.zip_with(each, parts, lambda ids, s: F.when(s["scored"], ids).otherwise(F.array_repeat(F.lit(IGNORE), F.size(ids))))
    return F.struct(F.flatten(each).alias("ids"), F.flatten(label).alias("labels"))


def with_end(ids: Column, end: int = END) -> Column:
    """Ids with the end token."""
    return F.concat(ids, F.array(F.lit(end)))


def preference(decision: Column, a: Column, b: Column) -> Column:
    """``struct<chosen, rejected>``: both null unless one side was preferred."""
    return F.struct(F.when(decision == "a", a).when(decision == "b", b).alias("chosen"), F.when(decision == "a", b).when(decision == "b", a).alias("rejected"))


def slot(key: Column, seed: int = 0) -> Column:
    """0 or 1 with equal chance, the same for a key always: which candidate is shown first."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)).cast("int")
