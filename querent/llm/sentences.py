"""Sentence boundaries across languages and scripts.

The rules are compiled into a finite transducer: a dense table from (state, class of event) to (state,
cut). What an event is depends only on the text near it (``MARGIN``). Texts longer than a chunk are
cut into rows. A backward scan over the chunks tells which quotations close; then each chunk is a
function from the state before it to the state after it, with the cuts it makes, and the functions are
composed by a prefix scan in two levels, which tells the state in which each chunk begins. A chunk is
the same rows of the table for every text, so results don't depend on where texts are cut into chunks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querent.plans.staging import Stage

#: Characters of a chunk, and of text that is seen on either side of it. White space, parentheses and
#: runs of terminators are looked at over ``NEAR`` characters, so that no event sees beyond the margin.
CHUNK_CHARS, MARGIN, NEAR = 65536, 2048, 256
#: Chunk functions that are composed at once; two levels reach further than the longest string.
FAN = 256

# Abbreviations that never end a sentence, that end one only before a capital or an
# opening mark, and that are followed by a number.
NEVER_END = frozenset(
    "mr mrs ms dr prof st mme mlle mm m sr sra srta dra d.ª ing hr fr "
    "vs approx i.e e.g cf viz fig figs sec ch vol eq p pp art arts pág págs ej núm "
    "abs nr ca bzw z b d h ggf evtl vgl str tel inkl "
    "т е г гг ул стр рис см им пр напр тов "
    "κ κα βλ σελ δηλ π.χ αρ "
    "إلخ د ص م أ "
    "डॉ पृ श्री प्रो सं".split()
)
MAY_END = frozenset("a.m p.m etc ltd inc co corp u.k u.s u.s.a jr usw env u.a д др".split())
BEFORE_NUMBER = frozenset("no nos núm num".split())
MONTHS_DE = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_TERMINATORS = ".!?…。！？｡।॥؟۔;;‼⁇⁈⁉"
_HARD = frozenset("!?。！？｡।॥؟۔‼⁇⁈⁉")
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"', "〈": "〉", "《": "》"}
_KINDS = sorted(set(_OPEN.values()))
_QUOTES = sorted({*_OPEN, *_KINDS})

# States: at the start of a block, at the start of a sentence, within one, within a heading or list
# item, at the line start after one; then within each kind of quotation, which began a sentence or not.
BLOCK, BEGIN, INSIDE, LINE, AFTER = range(5)
_FIRST_QUOTE = 5
STATES = _FIRST_QUOTE + 2 * len(_KINDS)
# Classes of events: other text, a blank line, a line break, a Thai space, one with a line break, a
# bullet or heading mark, a number that may be one, a terminator; then each quotation mark, by whether
# it may open a quotation, and what follows if it closes one: nothing, a cut, a cut if it began a sentence.
WORD, BLANK, BREAK, THAI, THAI_BREAK, MARK, NUMBER, END = range(8)
_FIRST_MARK = 8
CLASSES = _FIRST_MARK + 6 * len(_QUOTES)
#: Cuts of a transition: none, where the event begins, where it ends.
_STAY, _BEFORE, _BEHIND = range(3)


def _quote_class(mark: str, opens: bool, effect: int) -> int:
    return _FIRST_MARK + 6 * _QUOTES.index(mark) + 3 * opens + effect


def _step(state: int, what: int) -> tuple[int, int]:
    """The rule for one state and one class of event."""
    quoted, fresh = state >= _FIRST_QUOTE, state in (BLOCK, BEGIN, AFTER)
    if what == BLANK:
        return BLOCK, _BEFORE
    if state == LINE:
        return (AFTER, _BEFORE) if what in (BREAK, THAI_BREAK) else (LINE, _STAY)
    if what >= _FIRST_MARK:
        at, rest = divmod(what - _FIRST_MARK, 6)
        opens, effect = divmod(rest, 3)
        if quoted:
            kind, inner = divmod(state - _FIRST_QUOTE, 2)
            if _QUOTES[at] != _KINDS[kind]:
                return state, _STAY
            return (BEGIN, _BEHIND) if effect == 1 or effect == 2 and not inner else (INSIDE, _STAY)
        return (_FIRST_QUOTE + 2 * _KINDS.index(_OPEN[_QUOTES[at]]) + (not fresh) if opens and _QUOTES[at] in _OPEN else INSIDE), _STAY
    if quoted or what == BREAK:
        return state, _STAY
    if what == WORD:
        return INSIDE, _STAY
    if what in (THAI, THAI_BREAK):
        return BEGIN, _BEFORE
    if what == END:
        return BEGIN, _BEHIND
    if what == MARK or state in (BLOCK, AFTER):  # a mark, or a number at the start of a block or after an item
        return LINE, _STAY if fresh else _BEFORE
    return state, _STAY


#: The compiled transducer: 3 * state + cut, for each state and class.
TABLE = [[3 * after + cut for after, cut in (_step(s, c) for c in range(CLASSES))] for s in range(STATES)]

_EVENT = re.compile(
    rf"(?P<line>(?<!\s)[^\S\r\n  ]{{0,{NEAR}}}+[\r\n  ]\s{{0,{NEAR}}})"
    rf"|(?P<thai>(?<=[฀-๿”“\"])[^\S\r\n]{{1,{NEAR}}}(?=\S)|(?<=\S)[^\S\r\n]{{1,{NEAR}}}(?=[฀-๿]))"
    rf"|(?P<end>(?<![{re.escape(_TERMINATORS)}])[{re.escape(_TERMINATORS)}]{{1,{NEAR}}})"
    rf"|(?P<quote>[{''.join(_QUOTES)}])"
)
_MARK = re.compile(r"(?P<kind>[-*•‣▪–]|#{1,6}|\d{1,3}[.)])(?=[^\S\r\n])")
_TOKEN = re.compile(r"[^\s(\[\"“„«,;:!?…。！？]{1,24}$")
_NEXT = re.compile(rf"\s{{0,{NEAR}}}")
_CLOSED = re.compile(r"[)）\]］’]{0,16}")
_PAREN = re.compile(r"[()（）]")
_BLANK_LINE = re.compile(r"\n\s*\n|\r\s*\r| ")
_FOLLOWING = re.compile(r"\w{1,24}")


def _in_parentheses(text: str) -> list[tuple[int, int]]:
    """Stretches in a pair of parentheses that lie within ``NEAR`` characters and one block."""
    spans, opened = [], []
    for m in _PAREN.finditer(text):
        at = m.start()
        if text[at] in "(（":
            opened.append(at)
        elif opened:
            began = opened.pop()
            if at - began <= NEAR and not _BLANK_LINE.search(text, began, at):
                while spans and spans[-1][0] > began:
                    spans.pop()
                spans.append((began, at))
    return spans


def _decides(text: str, at: int, end: int, n: int) -> int:
    """The position after the terminators at text[at:end] and their closers if they can end a sentence, else -1."""
    marks = text[at:end]
    stop = end
    stop = _CLOSED.match(text, stop).end()
    nxt = _NEXT.match(text, stop).end()
    spaced = nxt > stop
    ahead = text[nxt] if nxt < n and nxt - stop < NEAR else ""
    if ";" in marks or ";" in marks:  # the Greek question mark; elsewhere a pause
        greek = "GREEK" in unicodedata.name(text[at - 1] if at else " ", "")
        return stop if ";" in marks or greek and len(marks) == 1 else -1
    if not ahead:
        return stop
    if ahead in ",;:、，；：،؛" or ahead.islower():
        return -1
    if ahead in "”“»」』\"" and not spaced and text[nxt] != "\"":
        return stop
    cased = ahead.isupper() or ahead.istitle()
    opening = ahead in "¿¡«„“\"'‘(「『[-—–"
    if set(marks) & _HARD:
        return stop
    if "…" in marks or marks.startswith(".."):
        return stop if cased or opening else -1
    # a full stop
    if not spaced and stop == end and (ahead.isdigit() or not ahead.isalpha() and ahead not in "¿¡«„“\"「『"):
        return -1
    if found := _TOKEN.search(text, max(0, at - 32), at):
        word = found.group().lower().strip(".'’*_")
        if "." in word and max(map(len, word.split("."))) > 3:
            word = word.rpartition(".")[2]  # a sentence without space before this one
        if word in BEFORE_NUMBER:
            return -1 if ahead.isdigit() else stop
        if word in NEVER_END:
            return -1
        if len(word) == 1 and word.isalpha() and found.group()[-1:].isupper():
            return -1
        if word in MAY_END or "." in word and re.fullmatch(r"(?:\w\.)+\w", word):
            return stop if (cased or opening) and spaced else -1
        if word.isdigit() and len(word) <= 2 and spaced:
            following = _FOLLOWING.match(text, nxt)
            if following and following.group().lower() in MONTHS_DE:
                return -1
    return stop


def _is_thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _events(text: str, lo: int, hi: int, at_start: bool) -> list[tuple[int, int, int, tuple | None]]:
    """(class, position, end, mark) for the events that begin in text[lo:hi]; for quotation marks, the class but for whether they open one."""
    out, n, spans, inside = [], len(text), None, 0
    if at_start and (mark := _MARK.match(text, _NEXT.match(text).end())):
        out.append((NUMBER if mark["kind"][0].isdigit() else MARK, mark.start(), mark.start(), None))
    for m in _EVENT.finditer(text):
        at, end, what = m.start(), m.end(), m.lastgroup
        if not lo <= at < hi:
            continue
        if what == "end":
            stop = _decides(text, at, end, n)
            if stop < 0:
                continue
            if spans is None:
                spans = _in_parentheses(text)
            while inside < len(spans) and spans[inside][1] < at:
                inside += 1
            if inside == len(spans) or spans[inside][0] > at:
                out.append((END, at, stop, None))
        elif what == "quote":
            ahead_at = _NEXT.match(text, end).end()
            ahead = text[ahead_at] if ahead_at < n and ahead_at - end < NEAR else ""
            back = at
            while back and text[back - 1].isspace() and at - back < 8:
                back -= 1
            effect = 0
            if back > 0 and text[back - 1] in _TERMINATORS.replace(";", ""):
                effect = 1 if ahead.isupper() or not ahead else 0 if ahead.islower() or ahead in ".,;:!?…、，。；：！？،؛।)" else 2
            mark = text[at]
            may_open = mark in _OPEN and (mark != '"' or not (at and text[at - 1].isalnum()))
            out.append((_quote_class(mark, False, effect), at, end, (mark, may_open)))
        else:
            ahead, before = text[end] if end < n else "", text[at - 1] if at else ""
            got = m.group()
            if what == "line" and max(got.count("\n") + got.count(" "), got.count("\r")) + 2 * got.count(" ") > 1:
                out.append((BLANK, at, end, None))
            else:
                thai = ahead and (_is_thai(before) or _is_thai(ahead)) and not (ahead.isdigit() or before.isdigit())
                if thai and not (before in "”“\"" and not _is_thai(ahead)):
                    out.append((THAI_BREAK if what == "line" else THAI, at, end, None))
                elif what == "line":
                    out.append((BREAK, at, end, None))
            if what == "line" and (mark := _MARK.match(text, end)):
                out.append((NUMBER if mark["kind"][0].isdigit() else MARK, end, end, None))
    return out


def _ahead(events: list[tuple], after: list[bool]) -> list[bool]:
    """Which kinds of quotation close in their block from the first event on, if ``after`` tells it for the text behind."""
    ahead = list(after)
    for what, _, _, mark in reversed(events):
        if what == BLANK:
            ahead = [False] * len(_KINDS)
        elif mark and mark[0] in _KINDS:
            ahead[_KINDS.index(mark[0])] = True
    return ahead


def _symbols(text: str, events: list[tuple], lo: int, hi: int, after: list[bool]) -> list[tuple[int, int, int]]:
    """(class, position, end): the input of the transducer, with the text between events, and with what opens quotations settled."""
    ahead, opens = list(after), [False] * len(events)
    for i in range(len(events) - 1, -1, -1):
        what, _, _, mark = events[i]
        if what == BLANK:
            ahead = [False] * len(_KINDS)
        elif mark:
            opens[i] = mark[1] and ahead[_KINDS.index(_OPEN[mark[0]])]
            if mark[0] in _KINDS:
                ahead[_KINDS.index(mark[0])] = True
    out, behind = [], lo
    for (what, at, end, mark), opening in zip(events, opens):
        if at > behind and not (text[behind].isspace() and text[behind:at].isspace()):
            out.append((WORD, behind, at))
        out.append((what + 3 * opening if mark else what, at, end))
        behind = max(behind, end)
    if hi > behind and not text[behind:hi].isspace():
        out.append((WORD, behind, hi))
    return out


def _walk(symbols: list[tuple[int, int, int]], state: int) -> tuple[list[int], list[int], list[int]]:
    """The states after each symbol, the cuts, and how many cuts there are after each symbol."""
    states, cuts, counts = [], [], []
    for what, at, end in symbols:
        state, cut = divmod(TABLE[state][what], 3)
        if cut:
            cuts.append(at if cut == _BEFORE else end)
        states.append(state)
        counts.append(len(cuts))
    return states, cuts, counts


def _spot(text: str, at: int) -> tuple[int, int]:
    """Where the text before a cut ends, and where the next begins."""
    own = text[max(0, at - MARGIN) : at]
    begin = at
    while begin < len(text) and text[begin].isspace():
        begin += 1
    return at - (len(own) - len(own.rstrip())), begin


def _run(text: str, events: list[tuple], state: int, lo: int, hi: int) -> tuple[int, list[tuple[int, int]]]:
    """The state after text[lo:hi], if no quotation closes behind it, and the cuts."""
    states, cuts, _ = _walk(_symbols(text, events, lo, hi, [False] * len(_KINDS)), state)
    return states[-1] if states else state, [_spot(text, at) for at in cuts]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that are one chunk, from the first state."""
    for b in batches:
        docs, begins, ends = [], [], []
        for row, text in enumerate(b.column(1).to_pylist()):
            size = len(text)
            cuts = _run(text, _events(text, 0, size, True), BLOCK, 0, size)[1]
            at = size - len(text.lstrip())
            for end, begin in (*cuts, (len(text.rstrip()), size)):
                if at < end:
                    docs.append(row)
                    begins.append(at)
                    ends.append(end)
                at = begin
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["doc", "sent_start", "sent_end"])


def _cut(chunk_chars: int):
    """Each text as chunks with what is seen on either side of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for n, first in enumerate(range(0, len(text), chunk_chars)):
                    low = max(0, first - MARGIN)
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([n], pa.int32()), pa.array([first]), pa.array([first - low], pa.int32()), pa.array([min(chunk_chars, len(text) - first)], pa.int32()), pa.array([text[low : first + chunk_chars + MARGIN]])], ["row", "n", "first", "skip", "length", "text"])

    return run


def _closings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk and kind of quotation: 1 it closes before a blank line, 0 it doesn't, 2 the chunk doesn't tell."""
    for b in batches:
        told = []
        for n, skip, length, text in zip(*(b.column(c).to_pylist() for c in ("n", "skip", "length", "text"))):
            events = _events(text, skip, skip + length, n == 0)
            low, high = _ahead(events, [False] * len(_KINDS)), _ahead(events, [True] * len(_KINDS))
            told.append([2 if x != y else int(x) for x, y in zip(low, high)])
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(told, pa.list_(pa.int32()))], ["row", "n", "told"])


_SPOT = "struct<e:bigint,s:bigint>"


def _chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk as a function of the state before it: the state after it, and its cuts.

    ``cuts`` has those made from the first state; another state has ``own`` cuts until it comes to the
    same state at the same symbol, and from ``skip`` on shares those of the first. A cut is where the
    text before it ends and where the next begins (null if that lies beyond what the chunk sees).
    """
    for b in batches:
        rows = []
        for n, first, skip, length, text, told in zip(*(b.column(c).to_pylist() for c in ("n", "first", "skip", "length", "text", "told"))):
            lo, hi, base = skip, skip + length, first - skip
            symbols = _symbols(text, _events(text, lo, hi, n == 0), lo, hi, [x == 1 for x in told])

            def spot(at: int, text: str = text, base: int = base) -> dict:
                end, begin = _spot(text, at)
                return {"e": base + end, "s": base + begin if begin < len(text) else None}

            states, cuts, counts = _walk(symbols, BLOCK)
            after, own, from_ = [], [], []
            for start in range(STATES):
                state, mine, shared = start, [], len(cuts)
                for i, (what, at, end) in enumerate(symbols):
                    state, cut = divmod(TABLE[state][what], 3)
                    if cut:
                        mine.append(at if cut == _BEFORE else end)
                    if state == states[i]:
                        state, shared = states[-1], counts[i]
                        break
                after.append(state)
                own.append([spot(x) for x in mine])
                from_.append(shared)
            part = text[lo:hi]
            bare = part.strip()
            head = first + len(part) - len(part.lstrip())
            rows.append((after, [spot(x) for x in cuts], own, from_, head if bare else None, head + len(bare) if bare else None))
        spots = pa.list_(pa.struct([("e", pa.int64()), ("s", pa.int64())]))
        kinds = [pa.list_(pa.int32()), spots, pa.list_(spots), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], ["row", "n", "after", "cuts", "own", "from", "head", "tail"])


def _folded(functions: Column, start: Column) -> Column:
    """The state to which functions, one after the other, lead from a state."""
    return F.aggregate(functions, start.cast("int"), lambda s, f: F.get(f, s))


def _states_before(functions: DataFrame) -> DataFrame:
    """Adds ``state``, in which each chunk begins: functions of ``FAN`` chunks are composed, then those of a text, then down again."""
    f = functions.withColumn("block", (F.col("n") / FAN).cast("int"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "after"))), lambda x: x["after"])
    every = F.sequence(F.lit(0), F.lit(STATES - 1))
    blocks = f.groupBy("row", "block").agg(listed.alias("fs")).withColumn("after", F.transform(every, lambda s: _folded(F.col("fs"), s)))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("row", "block", _folded(F.collect_list("after").over(upto("row").orderBy("block")), F.lit(BLOCK)).alias("start"))
    return f.join(starts, ["row", "block"]).withColumn("state", _folded(F.collect_list("after").over(upto("row", "block").orderBy("n")), F.col("start"))).drop("block", "start")


def _long_texts(stage: Stage, texts: DataFrame, chunk_chars: int) -> DataFrame:
    """(row, sent_start, sent_end) of texts (row, text) of more than one chunk."""
    shape = "row long, n int, first long, skip int, length int, text string"
    chunks = stage.write(texts.select("row", "text").mapInArrow(_cut(chunk_chars), shape).repartition("row", "n"), "chunks")
    told = chunks.mapInArrow(_closings, "row long, n int, told array<int>")
    back = Window.partitionBy("row").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    known = [F.coalesce(F.last(F.when(F.col("told")[i] < 2, F.col("told")[i]), ignorenulls=True).over(back), F.lit(0)) for i in range(len(_KINDS))]
    ahead = stage.write(told.select("row", "n", F.array(*known).alias("told")), "ahead")
    made = chunks.join(ahead, ["row", "n"]).mapInArrow(_chunk_functions, f"row long, n int, after array<int>, cuts array<{_SPOT}>, own array<array<{_SPOT}>>, `from` array<int>, head long, tail long")
    functions = _states_before(stage.write(made, "functions"))
    stage.drop(chunks, ahead)
    spots = F.concat(F.get("own", F.col("state")), F.filter("cuts", lambda _, i: i >= F.get("from", F.col("state"))))
    forth = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = functions.select("row", "n", spots.alias("spots"), "head", "tail", F.last("head", ignorenulls=True).over(back).alias("next"))
    placed = placed.withColumn("before", F.coalesce(F.sum(F.size("spots")).over(forth), F.lit(0)))
    # a cut ends one unit and begins the next; a text begins the first and ends the last
    each = placed.select("row", "before", "next", F.posexplode("spots").alias("i", "x"))
    ends = each.select("row", (F.col("before") + F.col("i")).alias("unit"), F.lit(None).cast("long").alias("s"), F.col("x.e").alias("e"))
    begins = each.select("row", (F.col("before") + F.col("i") + 1).alias("unit"), F.coalesce("x.s", "next").alias("s"), F.lit(None).cast("long").alias("e"))
    edge = placed.groupBy("row").agg(F.min("head").alias("s"), F.max("tail").alias("e"), F.sum(F.size("spots")).alias("unit"))
    outer = edge.select("row", F.lit(0).cast("long").alias("unit"), "s", F.lit(None).cast("long").alias("e")).unionByName(edge.select("row", "unit", F.lit(None).cast("long").alias("s"), "e"))
    units = ends.unionByName(begins).unionByName(outer).groupBy("row", "unit").agg(F.max("s").alias("sent_start"), F.max("e").alias("sent_end"))
    return units.filter("sent_start < sent_end").select("row", "sent_start", "sent_end")


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc, sent_start, sent_end): every sentence of every text, code points, without outer whitespace.

    Terminators and closing quotes belong to the sentence; a quotation within a sentence doesn't divide
    it, if it closes before a blank line; headings and list items are one unit; a blank line always ends
    a unit. Null and blank texts, and an empty table, give no rows; rows without id give rows with a
    null id; repeated rows give repeated rows. ``chunk_chars`` doesn't change the result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("text is not null and text <> ''")
    short = docs.filter(F.length("text") <= chunk_chars).mapInArrow(_whole, f"doc {kind}, sent_start long, sent_end long")
    stage = Stage(df.sparkSession, "sentences")
    # repeated and null ids stay apart
    long = stage.write(docs.filter(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id()), "long")
    if long.isEmpty():
        return short
    found = stage.write(_long_texts(stage, long, chunk_chars), "found")
    return short.unionByName(found.join(long.select("row", "doc"), "row").select("doc", "sent_start", "sent_end"))
