"""Texts that end before their author's text did.

Two kinds of evidence meet. Field limits show as lengths at which far more texts end than at the lengths around them:
per source, and in characters, UTF-8 bytes and UTF-16 units, the discrete hazard of each length (texts that end there
over texts that get there) is tested against the hazards of its neighbours, with the false discovery rate controlled
over all tests. Endings are judged by the corpus: how often the last two words (else the last one) end a sentence or
line elsewhere. A cut in transfer has no length in common with others and shows by its ending alone, which the hazards
can't give; so an ending that is clearly unfinished is flagged at any length, one that is merely open at significant
lengths or where the source reported a longer text.

Null and empty texts, and texts without a word, are never flagged. Repeated rows are judged alike. All statistics cover
all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import ship, stage

#: Lengths to each side that a hazard is compared with, and the false discovery rate.
NEIGHBOURS, FALSE_DISCOVERIES = 30, 0.01
#: A limit's hazard is more than so many times that of its neighbours. This, not equality, is the hypothesis to reject:
#: with enough texts any uneven length (a usual subject line, say) differs from its neighbours significantly.
LEAST_EFFECT = 2.0
#: Lengths just beside, whose hazard counts too where it is the higher one: a limit is a single length, a usual length a hill.
BESIDE = 4
#: No field that holds a sentence is shorter.
LEAST_LIMIT = 20
#: An ending is unfinished when its words end a sentence in less than this share of cases; OPEN_SHARE with some evidence.
UNFINISHED_SHARE, OPEN_SHARE = 0.006, 0.25
#: A text shorter than this is judged by marks only, one that ends inside a word from this length on.
LEAST_TEXT, LEAST_BROKEN = 20, 10
#: A reported length is taken for the author's only if it exceeds the text's by more than such misreports do.
MISREPORT = 45

# Marks that cutters leave.
_MARK = re.compile(r"\s*(?:\[\s*(?:truncated|cut|snip|snipped|more|…|\.\.\.)\s*\]|\(\s*(?:truncated|cut|more|continued)\s*\)|<\s*(?:truncated|snip)\s*>|(?:\.\.\.|…)\s*(?:\[|\()?(?:read more|more|truncated|cut)(?:\]|\))?)\s*$", re.IGNORECASE)
_DOTS = re.compile(r"(?:…|\.{3,})\s*$")
_FULL = ".!?。！？｡؟।"
_CLOSERS = "\"'”’»)]）」』*_"
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.MULTILINE)
#: Words: code in backticks, paths and dotted names, numbers and ids, CJK characters one by one, other words.
_WORD = re.compile(r"`[^`\n]*`|https?://\S+|[\w.-]*/[\w./-]*\w|[A-Z][A-Z_]+-?\d+|\d[\d.,:%×/x]*|[぀-ヿ㐀-鿿가-힯]|[^\W\d_][\w'’-]*")
_NEXT = re.compile(r"[\"'”’»)\]）」』*_]*(?:[ ]?(?:\.{3,}|…)|[.!?。！？｡؟।](?=[\s\"'”’»)\]）」』*_]|$|[^\x00-\x7f])|[。！？]|[ \t]*(?:\r?\n|$))")

#: A word and, where it ends a sentence or line, what follows.
_ENDED = re.compile(rf"({_WORD.pattern})(?:(?=({_NEXT.pattern})))?")


def _key(word: str) -> str:
    c = word[0]
    if c == "`":
        return "`"
    if "/" in word:
        return "/"
    if c.isdigit():
        return "0"
    if word[-1].isdigit() and word[:2].isupper():
        return "#"
    return word.lower()


#: What a cutter's mark can end in.
_MARK_ENDS = ("]", ")", ">", "more", "cut", "truncated")


def _mark(text: str) -> re.Match | None:
    """The mark of a cutter at the end of a text."""
    return _MARK.search(text) if text.rstrip().lower().endswith(_MARK_ENDS) else None


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(_key(m[0]), m.start(), m.end()) for m in _WORD.finditer(text)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of words and each word occurs, ends a sentence or line, and is a text's last; summed per task."""
    seen: Counter = Counter()
    ends: Counter = Counter()
    last: Counter = Counter()
    keys: dict[str, str] = {}
    for b in batches:
        for text in b.column(0).to_pylist():
            if m := _mark(text):
                text = text[: m.start()]
            # The line end behind the text makes its last word an end like one before any other line end.
            found = _ENDED.findall(text + "\n")
            if not found:
                continue
            words = []
            for w, _ in found:
                k = keys.get(w)
                if k is None:
                    if len(keys) > 500_000:
                        keys.clear()
                    k = keys[w] = _key(w)
                words.append(k)
            pairs = [f"{x} {y}" for x, y in zip(["", *words], words)]
            seen.update(words)
            seen.update(pairs)
            ended = [i for i, (_, e) in enumerate(found) if e]
            ends.update([words[i] for i in ended])
            ends.update([pairs[i] for i in ended])
            last[words[-1]] += 1
            last[pairs[-1]] += 1
        if len(seen) > 500_000:
            yield _counted(seen, ends, last)
            seen, ends, last = Counter(), Counter(), Counter()
    if seen:
        yield _counted(seen, ends, last)


def _counted(*counts: Counter) -> pa.RecordBatch:
    keys = list(counts[0])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["key", "seen", "ends", "last"])


def _ending(text: str) -> tuple[str, str, str]:
    """(class of the ending, pair key, word key); classes: marked, broken, full, dots, sealed, unclosed, open, none."""
    body = text.rstrip()
    if not body:
        return "none", "", ""
    if body[-1] == "�":
        return "broken", "", ""
    if _mark(body):
        return "marked", "", ""
    dots = False
    if m := _DOTS.search(body):
        if m.start() and body[m.start() - 1].isspace() and body[: m.start()].rstrip()[-1:] in _FULL:
            return "dots", "", ""
        body, dots = body[: m.start()].rstrip(), True
    fenced = len(_FENCE.findall(body)) % 2
    line = body[body.rfind("\n") + 1 :]
    words = _words(line)
    if fenced and not (line.rstrip(_CLOSERS)[-1:] and line.rstrip(_CLOSERS)[-1] in _FULL):
        return "unclosed", "", ""
    if not words:
        return "sealed", "", ""
    pair = f"{words[-2][0] if len(words) > 1 else _before(body, line)} {words[-1][0]}"
    if re.match(r"\s*(?:```|~~~|</\w|\|.*\|\s*$|[-=*_]{3,}\s*$)", line):
        return "sealed", pair, words[-1][0]
    if line.count("`") % 2 or _open_bracket(line):
        return "unclosed", pair, words[-1][0]
    core = line.rstrip(_CLOSERS)
    if core[-1:] and core[-1] in _FULL and not dots:
        return "full", pair, words[-1][0]
    tail = body[-1]
    if not dots and not tail.isalnum() and tail not in "`,;:-–—/\\_(\"'":
        return "sealed", pair, words[-1][0]
    if re.match(r"\s*(?:--+\s|—\s|Ticket|Signed-off-by|Co-authored-by|Refs?:|Fixes|Closes|see\s)", line) and len(line) < 80:
        return ("dots" if dots else "trailer"), pair, words[-1][0]
    return ("dots-open" if dots else "open"), pair, words[-1][0]


def _before(body: str, line: str) -> str:
    """The last word before the last line; no word spans lines."""
    end = len(body) - len(line) - 1
    while end > 0:
        start = body.rfind("\n", 0, end) + 1
        if words := _words(body[start:end]):
            return words[-1][0]
        end = start - 1
    return ""


def _open_bracket(line: str) -> bool:
    depth = 0
    for c in line:
        if c in "(（":
            depth += 1
        elif c in ")）" and depth:
            depth -= 1
    return depth > 0


_ENDINGS = "doc_id bigint, source string, n_chars bigint, chars bigint, bytes bigint, units bigint, kind string, pair string, word string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(3).to_pylist()
        found = [_ending(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(t.encode("utf-16-le")) // 2 for t in texts], pa.int64()),
             *(pa.array([f[k] for f in found], pa.string()) for k in range(3))],
            names=["doc_id", "source", "n_chars", "chars", "bytes", "units", "kind", "pair", "word"],
        )


def length_limits(endings: DataFrame, neighbours: int = NEIGHBOURS, rate: float = FALSE_DISCOVERIES, effect: float = LEAST_EFFECT) -> DataFrame:
    """source, measure, length, n, hazard, around of each length whose hazard is significantly above `effect` times its
    neighbours'.

    The windows run over the distinct lengths of a source, as many as the longest text at most, never over its rows.
    p-values are Chernoff bounds of the binomial tail, so the rate is controlled from the safe side (Benjamini-Hochberg).
    """
    long = endings.select("source", F.explode(F.create_map(*[x for m in ("chars", "bytes", "units") for x in (F.lit(m), F.col(m))])).alias("measure", "length"))
    counts = long.groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "measure").orderBy("length")
    at_risk = F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing))
    h = counts.withColumn("risk", at_risk)

    def mean_hazard(reach: int):
        near = by.rangeBetween(-reach, reach)
        # Lengths at which nothing ended have no row; about as many texts got there as to the length itself.
        passed = F.greatest(F.sum("risk").over(near) - F.col("risk"), F.col("risk") * float(reach), F.lit(1.0))
        return (F.sum("n").over(near) - F.col("n") + 0.5) / passed

    h = h.withColumn("wide", mean_hazard(neighbours)).withColumn("close", mean_hazard(BESIDE)).withColumn("around", F.greatest("wide", "close"))
    h = h.withColumn("hazard", F.col("n") / F.col("risk"))
    q, p = F.col("hazard"), F.least(F.col("around") * effect, F.lit(0.999))
    kl = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    tested = stage(h.withColumn("logp", F.when(q > p, -F.col("risk") * kl).otherwise(0.0)), "hazards")
    # Only p-values up to the rate itself can pass, so the ranking is over those few; how many tests there were is a number.
    m = max(tested.count(), 1)
    order = Window.orderBy("logp", "source", "measure", "length")
    ranked = tested.where(F.col("logp") <= math.log(rate)).withColumn("k", F.row_number().over(order))
    last = F.max(F.when(F.col("logp") <= F.log(F.col("k") * rate / m), F.col("k"))).over(Window.partitionBy())
    passed = ranked.withColumn("last", last).where((F.col("k") <= F.col("last")) & (F.col("length") >= LEAST_LIMIT))
    return passed.select("source", "measure", "length", "n", "hazard", "around")


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by word, the asked ones with which a known word begins: the words that begin with another follow it
    without a gap. What is still open at the end of the partition, and its first known word, are passed on."""
    waiting: list[str] = []
    first, part = None, None
    for b in batches:
        out = []
        for word, known, part in zip(*(c.to_pylist() for c in b.columns)):
            while waiting and not word.startswith(waiting[-1]):
                waiting.pop()
            if not known:
                waiting.append(word)
                continue
            first = word if first is None else first
            out += [w for w in waiting if len(w) < len(word)]
            waiting = [w for w in waiting if len(w) == len(word)]
        yield _begun_rows(out, "begun", part)
    yield _begun_rows(waiting, "open", part)
    yield _begun_rows([] if first is None else [first], "first", part)


def _begun_rows(words: list[str], what: str, part: int | None) -> pa.RecordBatch:
    n = len(words)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([what] * n, pa.string()), pa.array([part] * n, pa.int32())], names=["word", "what", "part"])


def beginnings(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The words of `asked` (distinct) that are a proper beginning of a word of `known`, by one sort of both.

    Each partition of the sort is read once, in order; what hangs over its end is compared with the first known word
    behind it, a few rows for each partition."""
    both = asked.select("word", F.lit(False).alias("known")).union(known.select(F.col("key"), F.lit(True))).where(F.col("word") != "")
    found = stage(both.repartitionByRange("word").sortWithinPartitions("word", F.desc("known")).withColumn("part", F.spark_partition_id()).mapInArrow(_begun, "word string, what string, part int"), "beginnings")
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    edge = found.where("what != 'begun'").groupBy("part").agg(F.max(F.when(F.col("what") == "first", F.col("word"))).alias("first"), F.collect_list(F.when(F.col("what") == "open", F.col("word"))).alias("open"))
    over = edge.withColumn("next", F.first("first", ignorenulls=True).over(later)).select(F.explode("open").alias("word"), "next").where(F.startswith("next", "word")).select("word")
    return found.where("what = 'begun'").select("word").union(over)


def truncation_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, source, kind of ending, share of cases in which its last words end a sentence, at_limit, missing (characters
    that the source reported beyond those there), truncated."""
    ship(docs.sparkSession)
    texts = docs.where(F.col("text").isNotNull() & (F.col("text") != ""))
    endings = stage(texts.select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"), "text").mapInArrow(_judge, _ENDINGS), "endings")
    stats = stage(texts.select("text").mapInArrow(_count, "key string, seen bigint, ends bigint, last bigint").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("seen", "ends", "last"))), "word-ends")
    limits = stage(length_limits(endings), "limits")
    unsure = endings.where(F.col("kind").isin("open", "dots-open", "trailer", "full"))
    pairs = unsure.select(F.col("pair").alias("key")).union(unsure.select("word")).distinct()
    known = stage(stats.join(pairs, "key", "left_semi"), "tails")
    # Words that go on: the proper beginnings of words seen inside texts.
    inside = stats.where(~F.col("key").contains(" ") & (F.col("seen") - F.col("last") >= 3)).select("key")
    begun = beginnings(unsure.select("word").distinct(), inside).withColumn("begins", F.lit(True))
    two = known.select(F.col("key").alias("pair"), F.col("seen").alias("seen2"), F.col("ends").alias("ends2"), F.col("last").alias("last2"))
    one = known.select(F.col("key").alias("word"), F.col("seen").alias("seen1"), F.col("ends").alias("ends1"), F.col("last").alias("last1"))
    at = [
        endings.join(limits.where(F.col("measure") == m).select("source", F.col("length").alias(m)), ["source", m], "left_semi").select("doc_id")
        for m in ("chars", "bytes", "units")
    ]
    at_limit = at[0].union(at[1]).union(at[2]).distinct().withColumn("at_limit", F.lit(True))
    j = endings.join(two, "pair", "left").join(one, "word", "left").join(begun, "word", "left").join(at_limit, "doc_id", "left")
    def ending_share(k: int):
        """How often words end a sentence inside texts; for those that hardly occur elsewhere, how often at all. A text's
        own ending is counted in the statistics and taken out of them."""
        seen, ends, last = (F.coalesce(f"{c}{k}", F.lit(0)) for c in ("seen", "ends", "last"))
        usual = F.greatest(ends - last, F.lit(0)) / F.greatest(seen - last, F.lit(1))
        closing = F.greatest(ends - 1, F.lit(0)) / F.greatest(seen - 1, F.lit(1))
        return F.when((seen >= 6) & (last * 2 > seen), closing).otherwise(usual)

    broken_word = F.coalesce("begins", F.lit(False)) & (F.coalesce(F.col("seen1") - F.col("last1"), F.lit(0)) == 0)
    share = F.when(broken_word, 0.0).when(F.coalesce("seen2", F.lit(0)) >= 5, ending_share(2)).otherwise(ending_share(1))
    j = j.select(
        "doc_id", "source", "kind", "chars", share.alias("share"), broken_word.alias("broken"), F.coalesce("at_limit", F.lit(False)).alias("at_limit"),
        F.coalesce(F.col("n_chars") - F.greatest("chars", "bytes"), F.lit(0)).alias("missing"),
    )
    open_end, limit, lost = F.col("kind").isin("open", "dots-open"), F.col("at_limit"), F.col("missing")
    cut = (
        F.col("kind").isin("marked", "broken", "unclosed")
        | (open_end & (F.col("share") < UNFINISHED_SHARE) & (F.col("chars") >= LEAST_TEXT))
        | (open_end & F.col("broken") & (F.col("chars") >= LEAST_BROKEN))
        | (open_end & (limit | (lost > MISREPORT) | ((lost > 0) & (F.col("share") < OPEN_SHARE))))
        | ((F.col("kind") == "trailer") & limit & ((lost > 0) | (F.col("share") < OPEN_SHARE)))
        | (F.col("kind").isin("full", "sealed") & limit & (lost > MISREPORT))
    )
    return j.withColumn("truncated", cut).drop("broken")


def truncation_rates(evidence: DataFrame) -> DataFrame:
    """Texts, truncated texts and their share per source."""
    return evidence.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"), (F.count_if("truncated") / F.count("*")).alias("rate"))


