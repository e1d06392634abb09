"""Problem 9: texts that lost their end, and the rate of each source.

A stack automaton reads every text to its end and reports what is still open: fenced code, inline code, a bracket or
brace, a quotation of any kind, an element of markup. What was opened in the last paragraph makes a text truncated
whatever its last line says; what was opened before does so unless the source's other texts leave the same open as well
(`OPEN_SHARE`). Then the end itself is judged: a broken entity, escape or multibyte character, a terminator of any
script, a mark that stands for a lost rest, an ending that is whole without a terminator (a list item, a link, a
trailer, a title, a greeting), or neither.

What is whole without a terminator depends on the source, so it is learnt from all texts: last lines that recur in a
source (a greeting, a sign-off) are its baseline. A word in an ending that could be whole must also be a word of the
corpus, else the text stopped within it. Only other, different texts vouch for an ending: copies of a text count once,
and never for the text itself. Lengths at which a source's truncated texts pile up are reported as its field
limits; they decide nothing, as texts that end whole may have any length.

Scale: one narrow Python pass over the texts, then distinct counts of texts, by their hashes, for each (source, shape)
and each word asked for, all with map-side combining. The join back is by shape, length and last word of the doubtful texts only; the baselines are
reduced to the frequent ones first.

Defined cases: null, empty and blank texts stop nowhere, so they are no cases; a null source is a source of its own in
the report; repeated texts are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import materialise, table

# What ends a sentence, and what may follow that.
TERMINATORS = ".!?:;。！？．؟।。…"
CLOSERS = "\"'”’»)]}>*_`”』」）】〉》"
# Marks put where a rest was.
MARKS = re.compile(
    r"(?:\[\s*(?:\.\.\.|…|truncated|clipped|cut|snip|more|message (?:clipped|truncated)|text truncated|content truncated)\s*\]|\((?:more|truncated|continued|cut|\.\.\.|…)\)|<(?:snip|truncated|cut|more)>|>>\s*continued|-+\s*(?:truncated|snip)\s*-*|&hellip;|\(?read more\)?\s*(?:\.\.\.|…)?|\[message clipped\]|view entire message)\s*$",
    re.I,
)
# Endings with an ellipsis that are whole, by the idea they express: an open list or an open outcome.
OPEN_ENDED = re.compile(r"\b(?:and so on|and so forth|etc|et cetera|who knows|wait and see|time will tell|to be continued|and more|you never know|and the like|usw|u\.s\.w|und so weiter|et ainsi de suite|y así sucesivamente|e così via|enzovoort|и так далее|и т\. ?д)\s*(?:\.\.\.|…)\s*$|(?:等等|など)\s*(?:\.\.\.|…+)$", re.I)
# Greetings and other one-line messages.
SIGN_OFF = re.compile(r"^(?:(?:many |with |best |kind |warm )?(?:thanks|thank you|thx|cheers|regards|greetings)(?: (?:in advance|a lot|again|everyone|all|so much))?|lgtm|\+1|-1|ack|nack|wfm|ship it|done|fixed|ping|bump|best|ta|ok|yes|no|-- .{1,40}|—.{1,40}|~.{1,40}|[@/][\w./-]+)[,!]?$", re.I)
LINK = re.compile(r"(?:https?://|www\.)\S+$")
HEX_END = re.compile(r"(?:^|[\s/:#=])[0-9a-f]{5,}$")
TRAILER = re.compile(r"^(?:[A-Z][\w-]*(?: [\w-]+){0,2}:|(?:refs|closes|fixes|see|resolves|issue|bug|build(?: id)?|sha|digest|commit|version)\b)\s*\S+$", re.I)
ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(\S+(?: \S+){0,3})$")
ROW = re.compile(r"^\s*\|.*\|$")
HEADING = re.compile(r"^#{1,6}\s+\S")
FENCE = re.compile(r"^ {0,3}(?:> ?)*\s*(`{3,}|~{3,})(.*)$")
LINES = re.compile(r"\r\n|\r|\n")
LAST_WORD = re.compile(r"[^\W\d_]+$")
EMOJI = re.compile(r"[←-⯿\U0001f000-\U0001faff️‍✓]$")
BROKEN = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-Fa-f]?|&(?:[A-Za-z]{1,8}|#\d{0,6}|#x[0-9a-fA-F]{0,5}))$")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]$")

WHOLE, CUT, DOUBTFUL = "whole", "cut", "doubtful"
WORD_SHARE, OPEN_SHARE = 0.0001, 0.02


# Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SIGNS = re.compile(r"[()\[\]{}“”«»「」『』（）\"]|(?<![\w:])<[a-z][a-z0-9-]*(?:\s[^<>]*)?>|</[a-z][a-z0-9-]*\s*>")
OPENS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）"}
CLOSES = {v: k for k, v in OPENS.items()}


def structure(lines: list[str]) -> tuple[str | None, list[tuple[str, int]]]:
    """What is open at the end: (fence, stack of (sign, its line)), by an automaton over the whole text.

    A fence closes by its own letter, at least as many of them and nothing behind; anything else within is content. Outside
    of fences, inline code (within its paragraph), brackets, quotations, straight quotes and elements of markup go on the
    stack. A closing sign takes what lies above its opener with it; one without an opener (a smiley, a list's "a)") is none.
    """
    fence: str | None = None
    stack: list[tuple[str, int]] = []
    code: str | None = None  # the backticks of inline code that is open
    for k, line in enumerate(lines):
        if (m := FENCE.match(line)) is not None:
            mark, info = m[1], m[2]
            if fence is None:
                if not (mark[0] == "`" and "`" in info):
                    fence, code = mark, None
                    continue
            else:
                if mark[0] == fence[0] and len(mark) >= len(fence) and (not info.strip() or k == len(lines) - 1 and info[0] == " "):
                    fence = None  # behind the very last fence a remark may follow
                continue
        if fence is not None:
            continue
        if not line.strip():
            code = None
            continue
        if code is not None or "`" in line:
            kept = []
            for piece in re.split(r"(`+)", line):
                if code is not None:
                    code = None if piece == code else code
                elif piece[:1] == "`":
                    code = piece
                else:
                    kept.append(piece)
            line = " ".join(kept)
        for m in SIGNS.finditer(line):
            c = m[0]
            if c in OPENS:
                stack.append((c, k))
                continue
            if c == '"':
                opener = c if any(x == c for x, _ in stack) else None
                if opener is None:
                    stack.append((c, k))
            elif c in CLOSES:
                opener = CLOSES[c]
            else:
                name = re.match(r"</?([a-z0-9-]+)", c)[1]
                opener = "<" + name
                if name in VOID or c.endswith("/>"):
                    continue
                if c[1] != "/":
                    stack.append((opener, k))
                    continue
            if opener is not None and any(x == opener for x, _ in stack):
                while stack.pop()[0] != opener:
                    pass
    if code is not None:
        stack.append(("`", len(lines) - 1))
    return fence, stack


def judge(text: str) -> tuple[str, str | None, str | None]:
    """(verdict, shape of the last line, last word). The last two are set for doubtful ends only."""
    body = text.rstrip()
    if not body:
        return WHOLE, None, None
    lines = LINES.split(body)
    fence, stack = structure(lines)
    if fence is not None:
        return CUT, None, None
    verdict = ending(lines)
    if verdict[0] == CUT or not stack:
        return verdict
    start = len(lines) - 1
    while start and lines[start - 1].strip() and not FENCE.match(lines[start - 1]) and not ITEM.match(lines[start]):
        start -= 1
    if stack[-1][1] >= start:  # opened in the last paragraph
        return CUT, None, None
    return DOUBTFUL, "!" + "".join(sorted({x[0] for x, _ in stack})), "…"


def ending(lines: list[str]) -> tuple[str, str | None, str | None]:
    """What the last line says, whatever is open."""
    last = lines[-1].strip()
    if FENCE.match(last):
        return WHOLE, None, None
    shape = re.sub(r"\d+", "0", re.sub(r"[0-9a-f]{7,}", "h", last))
    if len(shape) > 80:  # the whole line counts, but only its hash is kept
        shape = hashlib.md5(shape.encode("utf-8", "replace")).hexdigest()
    if MARKS.search(last):
        return CUT, None, None
    ellipsis = last.endswith(("...", "…"))
    if ellipsis:
        return (WHOLE if OPEN_ENDED.search(last) else DOUBTFUL), shape, "…"
    if BROKEN.search(last) and not LINK.search(last):
        return CUT, None, None
    start = len(lines) - 1
    while start and lines[start - 1].strip() and not FENCE.match(lines[start - 1]) and not ITEM.match(lines[start]):
        start -= 1
    core = last.rstrip(CLOSERS)
    if last[-1] in TERMINATORS or (core and core[-1] in TERMINATORS) or EMOJI.search(last):
        # A terminator only in form: the point of "5.903", the dot of a name within code.
        if re.search(r"\b(?:[Vv]ersion|[Bb]uild|v|versión|versione|версия|Fassung|versão|versie) ?\d+\.$", last):
            return CUT, None, None
        if last[-1] in ":;" and last[-1] != "；" and not (last[-1] == ";" and re.search(r"[)\w\"']\s*;$", last)):
            return DOUBTFUL, shape, "…"
        return WHOLE, None, None
    word = (m := LAST_WORD.search(last)) and m[0].lower()
    if SIGN_OFF.match(last):
        return WHOLE, None, None
    if ROW.match(last) or (HEX_END.search(last) and (LINK.search(last) or len(last.split()) <= 3)):
        return WHOLE, None, None
    if LINK.search(last) or ITEM.match(last) or TRAILER.match(last) or HEADING.match(last):
        return DOUBTFUL, "~" + shape, word or ""
    before = "\n".join(lines[start:-1])
    words = len(last.split())
    if not before and words <= 9 and len(last) <= 64 and not re.search(r"[.!?。！？]\s", last) and not CJK.search(last) and all(not x.strip() for x in lines[:-1]):
        return DOUBTFUL, "=" + shape, word or ""  # the text is one short line: a title
    if not before and words <= 4:
        return DOUBTFUL, shape, "…"  # a paragraph of its own, whole if the source often ends so
    return CUT, None, None


CLOSING = re.compile(r"(?<![^\W\d_])([^\W\d_]+)[`\"')\]]*(?:[.!?]|\r?\n|\r)(?=\s*\S)")


def closing(text: str) -> list[str]:
    """The words that stand at the end of a line or sentence before the text's own end, each once."""
    return list(set(CLOSING.findall(text.lower())))


def key() -> Column:
    """A hash of the text: copies have the same, whatever their line ends and the blanks around them."""
    lines = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.xxhash64(F.trim(lines, F.lit(" \t\n"))).alias("key")


def ends(documents: DataFrame) -> DataFrame:
    """(doc_id, source, key, verdict, shape, word, closing) of every text that isn't null. key: as `key`; closing: as
    `closing`."""
    schema = "doc_id long, source string, key long, verdict string, shape string, word string, closing array<string>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            v = [judge(t) for t in texts]
            out = [b.column("doc_id"), b.column("source"), b.column("key"), *[pa.array(list(x) if v else [], pa.string()) for x in (zip(*v, strict=True) if v else ([], [], []))], pa.array([closing(t) for t in texts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), key()).mapInArrow(run, schema)


def truncated(documents: DataFrame, share: float = 0.0008, least: int = 4, word_docs: int = 3, word_share: float = WORD_SHARE) -> DataFrame:
    """(doc_id, source) of texts that stop before their end.

    Texts are counted without their copies, and the text in question is left out.
    OPEN_SHARE: the part of a source's other texts that must leave the same signs open for this to be usual there.
    share and least: a doubtful last line is whole where at least so large a part, and so many, of its source's texts
    end in it; the same holds for a last word among all texts. word_docs and word_share: a doubtful last word is also
    whole if so many, and so large a part, of the texts have it at the end of a line or sentence before their own end.
    """
    e = materialise(ends(documents).withColumn("source", F.coalesce("source", F.lit("\0"))))
    total = e.select("key").distinct().count()
    cut = e.filter(F.col("verdict") == CUT)
    doubt = e.filter(F.col("verdict") == DOUBTFUL)
    per_source = e.groupBy("source").agg(F.count_distinct("key").alias("of"))
    others = F.col("n") - 1
    usual = (
        doubt.groupBy("source", "shape").agg(F.count_distinct("key").alias("n")).join(per_source, "source")
        .filter((others >= least) & (others >= F.when(F.col("shape").startswith("!"), OPEN_SHARE).otherwise(share) * F.col("of"))).select("source", "shape", F.lit(True).alias("usual"))
    )
    asked = doubt.filter("word is not null and word not in ('', '…')").groupBy("word").agg(F.count_distinct("key").alias("finals"))
    # Only words that some doubtful text ends with are counted, and never the end of the text itself.
    inside = e.select("key", F.explode("closing").alias("word")).join(asked, "word", "left_semi").groupBy("word").agg(F.count_distinct("key").alias("docs"))
    known = asked.join(inside, "word", "left").select("word", F.coalesce("docs", F.lit(0)).alias("docs"), (F.col("finals") - 1).alias("finals"))
    judged = doubt.join(usual, ["source", "shape"], "left").join(known, "word", "left").withColumn("form", F.substring("shape", 1, 1))
    vouched = F.col("docs") - F.array_contains("closing", F.col("word")).cast("int")
    is_known = ((vouched >= word_docs) & (vouched >= word_share * total)) | ((F.col("finals") >= least) & (F.col("finals") >= share / 2 * total))
    no_form, has_word = ~F.col("form").isin("~", "="), ~F.col("word").isin("", "…")
    judged = judged.withColumn("bad", ~F.coalesce("usual", F.lit(False)) & (no_form | (has_word & ~F.coalesce(is_known, F.lit(False)))))
    found = cut.select("doc_id", "source").unionByName(judged.filter("bad").select("doc_id", "source"))
    return found.select("doc_id", F.nullif("source", F.lit("\0")).alias("source"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id")


def p9_rates(spark, sf_dir: str) -> DataFrame:
    """Texts and truncated texts of each source, a null source included."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = d.select("source", F.lit(1).alias("n"), F.col("text").isNotNull().cast("int").alias("t"), F.lit(0).alias("b")).unionByName(truncated(d).select("source", F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(1).alias("b")))
    return rows.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("t").alias("texts"), F.sum("b").alias("truncated")).withColumn("rate", F.round(F.col("truncated") / F.greatest("texts", F.lit(1)), 6))


def p9_limits(spark, sf_dir: str, least: int = 5, times: float = 4.0) -> DataFrame:
    """(source, unit, size, n): the lengths, in characters or bytes, that a source's truncated texts have far more often
    than nearby lengths: the limits of its field."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("size")))
    n = d.join(truncated(d).select("doc_id"), "doc_id", "left_semi").select("source", F.explode(units).alias("u")).groupBy("source", "u.unit", "u.size").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("size") / 32))
    near = n.groupBy("source", "unit", "band").agg(F.sum("n").alias("around"))
    return n.join(near, ["source", "unit", "band"]).filter((F.col("n") >= least) & (F.col("n") * 32 >= times * F.col("around"))).select("source", "unit", "size", "n")


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates, "p9_limits": p9_limits}
ORACLES: dict[str, str] = {}
