"""Repair of text from scanned pages.

Three kinds of noise are found and mended.  Furniture: lines at page edges are
told by repetition within the document, as folded by what scans confuse, and
page numbers by the sequence they form over its pages.  Misread characters: a
word whose fold is that of a word far more frequent in the corpus, and that
scan confusions lead to.  Words hyphenated at the end of a line: joined where
the corpus has the joined form rather than the hyphenated one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stage

# What a scan reads, and what was printed.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("2", "z"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("$", "s"),
    ("|", "l"), ("|", "i"), ("!", "l"), ("c", "e"), ("f", "t"), ("l", "i"), ("l", "t"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("d", "cl"),
    ("ii", "u"), ("li", "h"), ("vv", "w"), ("ü", "ti"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]

#: A lexicon word has at least this share of all words (so there are at most 1 / SHARE of them) and this count.
SHARE, COUNT = 1e-6, 4
#: A word is misread only if its reading is at least this many times as frequent.
RATIO = 25
#: A title is furniture if its fold stands at page edges of the document this often.
REPEATS = 2
#: What so many documents repeat is no running title of one of them.
DOCUMENTS = 12
#: No printed line has more characters; a running title leaves room beside it, so it has half as many.
WIDEST = 140
#: A line amid a sentence is taken for a title only if it fills no more of its neighbours' width than this.
ROOM = 0.8

_HYPHENS = "-‐­¬"
_EDGE = ".,;:?!\"'()[]{}“”„«»‘’¿¡…*_`"
_BROKEN = re.compile(rf"([^\W\d_][\w@|$’']*)[{_HYPHENS}][ \t]*$")
_STARTS = re.compile(r"[ \t]*([^\W_][\w@|$’']*)")
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_PAGE = rf"(?:[-–—]\s?{_NUMBER}\s?[-–—]|\[{_NUMBER}\]|(?:[Pp][a@]ge|PAGE|Seite|P[aá]gina|p\.)\s?\d{{1,4}}(?:\s?(?:of|/|de|von|sur)\s?\d{{1,4}})?|\d{{1,4}}\s?/\s?\d{{1,4}}|{_NUMBER})"
_PAGE_LINE = re.compile(rf"\s*{_PAGE}\s*")
_FIRST = re.compile(r"\d+|\b[ivxlcIVXLC]+\b")
_BARE = re.compile(r"\s*(?:\d+|[ivxlcIVXLC]+)\s*")
_TITLED = re.compile(rf"\s*(?P<t>\S(?:.*\S)?)(?:\s{{2,}}|\t+)(?P<p>{_PAGE})\s*|\s*(?P<q>{_PAGE})(?:\s{{2,}}|\t+)(?P<u>\S(?:.*\S)?)\s*")
_LISTED = re.compile(r"\s*(?:[-*+>|#`~]|\d+[.)]|data:)")
#: The classes of what a scan confuses, letter by letter, as what their members have in common: n may be ri, m rn, d cl, and so on.
_FOLD = str.maketrans(
    {c: "l" for c in "1i|!tf"} | {"0": "o", "2": "z", "5": "s", "$": "s", "6": "b", "8": "b", "9": "g", "@": "a", "e": "c", "n": "rl", "m": "rrl", "d": "cl", "u": "ll", "h": "ll", "w": "vv"}
    | {"ü": "ll", "ﬁ": "ll", "ﬂ": "ll", "ﬀ": "ll", "ﬃ": "lll", "ﬄ": "lll"}
)


def lexicon(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): lower-case words of letters only, with inner hyphens, that are frequent in the corpus."""
    tokens = texts.select(F.explode(F.split(F.lower(text), r"\s+")).alias("w")).where(F.length("w") > 0)
    # Tokens are counted as they stand; only distinct ones are looked at closely.
    distinct = tokens.groupBy("w").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}]+$", "")
    words = distinct.select(bare.alias("word"), "n").where((F.length("word") > 0) & F.col("word").rlike(r"^[\p{L}’']+(?:-[\p{L}’']+)*$"))
    counted = words.groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.where((F.col("n") >= COUNT) & (F.col("n") >= total * SHARE)).select("word", "n")


class Reader:
    """Decides about words with a lexicon of word counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.known: dict[str, str | None] = {}
        self.fixed: dict[str, tuple[tuple[int, int, str], ...]] = {}
        self.alike: dict[str, list[str]] = {}
        for w in counts:
            self.alike.setdefault(w.translate(_FOLD), []).append(w)

    def reading(self, word: str) -> str | None:
        """The printed form of a misread word, or None if it is none; casing of the rest is kept."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = self._reading(word)
        return self.known[word]

    def _reading(self, word: str) -> str | None:
        low = word.lower()
        letters = sum(c.isalpha() for c in low)
        if len(low) < 3 or letters < 2 or letters * 2 < len(low):
            return None
        least = max(COUNT, self.counts.get(low, 0) * RATIO)
        # Words of one fold are few, so each is tried; the fewest misread places win, then the most frequent word.
        best = None
        for w in self.alike.get(low.translate(_FOLD), ()):
            n = self.counts[w]
            if n >= least and w != low and (spots := _misreadings(low, w)) is not None and (best is None or (len(spots), -n, w) < best[0]):
                best = (len(spots), -n, w), spots
        return self._cased(word, best[1]) if best else None

    @staticmethod
    def _cased(word: str, chosen: list[tuple[int, str, str]]) -> str:
        """The reading in the case of the word: capitals where the misread part, or all letters of the word, are."""
        upper = "".join(c for c in word if c.isalpha()).isupper() and len(word) > 1
        out, last = "", 0
        for at, a, b in chosen:
            part = word[at : at + len(a)]
            out += word[last:at] + (b.upper() if part.isupper() or upper and not part.isalpha() else b)
            last = at + len(a)
        return out + word[last:]

    def fixes(self, token: str) -> tuple[tuple[int, int, str], ...]:
        """(place, length, reading) of the misread words of a token; codes, paths and long strings have none."""
        if token not in self.fixed:
            if len(self.fixed) > 500_000:
                self.fixed.clear()
            core = token.strip(_EDGE)
            at = token.find(core) if core else 0
            out = []
            if core and not _CODED.search(core) and not _CODE.fullmatch(core):
                for m in _PART.finditer(core):
                    if good := self.reading(m[0]):
                        out.append((at + m.start(), len(m[0]), good))
            self.fixed[token] = tuple(out)
        return self.fixed[token]

    def broken(self, left: str, right: str) -> bool:
        """Whether the two sides of a line-end hyphen are one word, rather than parts of a compound."""
        left, right = left.lower(), right.lower().rstrip("’'")
        whole, compound = self.counts.get(left + right, 0), self.counts.get(f"{left}-{right}", 0)
        if whole or compound:
            return whole > compound
        if self.reading(left + right):
            return True
        fixed = [self.reading(x) or x for x in (left, right)]
        if self.counts.get("-".join(fixed), 0):
            return False
        # Unknown either way: two whole words make a compound, a fragment makes a broken word.
        return not (self.counts.get(fixed[0], 0) and self.counts.get(fixed[1], 0))


def _misreadings(read: str, printed: str) -> list[tuple[int, str, str]] | None:
    """The fewest confusions (place, read, printed) that lead from what was printed to what was read; None if none do."""
    steps: dict[tuple[int, int], list[tuple[int, str, str]]] = {(0, 0): []}
    for i in range(len(read) + 1):
        for j in range(len(printed) + 1):
            spots = steps.pop((i, j), None)
            if spots is None:
                continue
            if i == len(read) and j == len(printed):
                return spots
            if i < len(read) and j < len(printed) and read[i] == printed[j]:
                _shorter(steps, (i + 1, j + 1), spots)
            for a, b in _BY_FIRST.get(read[i : i + 1], ()):
                if read.startswith(a, i) and printed.startswith(b, j):
                    _shorter(steps, (i + len(a), j + len(b)), [*spots, (i, a, b)])
    return None


def _shorter(steps: dict, at: tuple[int, int], spots: list) -> None:
    if at not in steps or len(spots) < len(steps[at]):
        steps[at] = spots


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))


def fold(line: str) -> str:
    """A line without spacing and signs, with what scans confuse made equal."""
    return "".join(c for c in line.lower().translate(_FOLD) if c.isalnum())


def _number(page: str) -> tuple[str, int]:
    """(style, value) of a page number: the style is what stands around it, and the total if there is one."""
    m = _FIRST.search(page)
    low = m[0].lower()
    value = int(low) if low.isdigit() else _roman(low)
    kind = "#" if low.isdigit() else "r" if m[0].islower() else "R"
    return page[: m.start()].strip().replace("@", "a") + kind + page[m.end() :].strip(), value


def _roman(low: str) -> int:
    each = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in low]
    return sum(-a if a < b else a for a, b in zip(each, [*each[1:], 0]))


#: Whether what stands at a page edge says so itself.
EDGE, CUT, BESIDE = 1, 2, 4


def candidates(lines: list[str]) -> list[tuple[int, str, str, int, int]]:
    """(line number, fold of its title, style and value of its page number, place) of the lines that may be furniture.

    Either of title and number may be missing.  Place has EDGE if the line
    stands at an end of the text or beside a blank line, CUT if it stands amid
    a sentence, and BESIDE if it stands next to a line with a page number.
    """
    out: dict[int, tuple[str, str, int, int]] = {}
    text = [i for i, line in enumerate(lines) if line.strip()]
    at = {i: n for n, i in enumerate(text)}
    code, fence = set(), False
    for i in text:
        marks = lines[i].lstrip().startswith(("```", "~~~"))
        if marks or fence:
            code.add(i)
        fence ^= marks
    free = [i for i in text if i not in code and len(lines[i]) <= WIDEST]

    for i in free:
        line = lines[i]
        if _PAGE_LINE.fullmatch(line):
            if _BARE.fullmatch(line):
                # Numbers one below the other are a column of values.
                if any((j := i + s) in at and _BARE.fullmatch(lines[j]) for s in (-1, 1)):
                    continue
                if not line.strip().isdigit() and len(line.strip()) == 1 and line.strip() not in "ivxIVX":
                    continue
            out[i] = ("", *_number(line.strip()), 0)
        elif ("  " in line.strip() or "\t" in line) and not _LISTED.match(line) and (m := _TITLED.fullmatch(line)):
            title = m["t"] or m["u"]
            if len(title) <= WIDEST // 2 and any(c.isalpha() for c in title) and not title.endswith((".", ",", ";", ":")):
                out[i] = (fold(title), *_number(m["p"] or m["q"]), 0)
    numbered = set(out)

    def beyond(i: int, step: int, over: set) -> int | None:
        n = at[i] + step
        while 0 <= n < len(text) and text[n] in over:
            n += step
        return text[n] if 0 <= n < len(text) else None

    def place(i: int, over: set) -> int:
        before, after = beyond(i, -1, over), beyond(i, 1, over)
        edge = before is None or after is None or not lines[i - 1].strip() or not lines[i + 1].strip()
        prose = all(j is not None and j not in code and not _LISTED.match(lines[j]) for j in (before, after))
        open_ = prose and lines[before].rstrip()[-1] not in _ENDS
        # Amid a sentence stands what leaves room for the next word of it; a line of the sentence itself is full.
        short = open_ and len(lines[i].strip()) + 1 + len(lines[after].split()[0]) <= ROOM * max(len(lines[before]), len(lines[after]))
        # Without a blank line on either side, a full open line before is enough; elsewhere the sentence must go on in lower case.
        within = short and lines[i - 1].strip() and lines[i + 1].strip() and len(lines[before]) >= ROOM * width
        cut = short and (lines[after].lstrip()[0].islower() or lines[before].rstrip()[-1] in _HYPHENS or within)
        if cut:
            return EDGE * edge + CUT
        # What goes on from the line before, or into the line after, is a line of their sentence.
        goes_on = before is not None and lines[before].rstrip()[-1] not in _ENDS and lines[i].lstrip()[0].islower() or after is not None and lines[after].lstrip()[0].islower()
        return 0 if goes_on else EDGE * edge

    width = max((len(lines[i]) for i in free if i not in out), default=0)
    titles: dict[int, tuple[str, str, int, int]] = {}
    for i in free:
        line = lines[i].strip()
        if i in out or not 3 <= len(line) <= WIDEST // 2 or _LISTED.match(line) or not any(c.isalpha() for c in line):
            continue
        if line[-1] in _ENDS or line[-1] in ",;" + _HYPHENS or ", " in line or re.search(r"\. (?!\d)", line):
            continue
        after = beyond(i, 1, numbered)
        if after is not None and after not in code and len(line) + 1 + len(lines[after].split()[0]) > width:
            continue  # the line is simply full
        titles[i] = (fold(line), "", 0, 0)
    for i, (f, style, value, p) in (out | titles).items():
        near = i in titles and any((j := beyond(i, s, set())) in numbered for s in (-1, 1))
        if i in titles:
            p = place(i, numbered)
            p += BESIDE * (near and p > 0)
        if i in numbered or p:
            out[i] = (f, style, value, p)
    return [(i, *v) for i, v in sorted(out.items())]


_ENDS = ".:?!…\"”»。|`"
_SPACED = re.compile(r"\S+")
_CODED = re.compile(r"[+=_:#<>~^&%\\/.]|--|\d\d")
_CODE = re.compile(r"[A-Z]{2,5}-\d+")
_PART = re.compile(rf"[^{_HYPHENS}’']+")


def _cut_word(line: str) -> re.Match | None:
    """The word before a hyphen at the end of the line, if there is one."""
    bare = line.rstrip(" \t")
    return _BROKEN.search(line, max(0, len(bare) - 64)) if bare and bare[-1] in _HYPHENS else None


def _misread(lines: list[str], reader: Reader) -> Iterator[tuple[int, int, int, str]]:
    """(line, place, length, reading) of the misread words outside code.

    Parts of words are no words: those at a line-end hyphen, and the last of
    the text, which may be cut.
    """
    fence, part = False, False
    last = max((i for i, line in enumerate(lines) if line.strip()), default=-1)
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        if bare.startswith(("```", "~~~")):
            fence = not fence
        if fence:
            continue
        found = list(_SPACED.finditer(line))
        ends = _cut_word(line) is not None
        first, stop = int(part), len(found) - int(ends or i == last)
        for m in found[first:stop]:
            for at, n, good in reader.fixes(m[0]):
                yield i, m.start() + at, n, good
        part = ends


def inspect(text: str, reader: Reader) -> tuple[bool, bool, list[tuple[int, str, str, int, int]]]:
    """(hyphen, chars, furniture candidates) of a section's text."""
    lines = text.split("\n")
    edge = candidates(lines)
    hyphen = any(True for _ in _breaks(lines, {c[0] for c in edge if c[2] or c[4] & (CUT | BESIDE)}, reader))
    chars = any(True for _ in _misread(lines, reader))
    return hyphen, chars, edge


def _breaks(lines: list[str], edge: set[int], reader: Reader) -> Iterator[tuple[int, int, str, str]]:
    """(line, next line, left, right) where a word is broken by the end of a line."""
    fence = False
    for i, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        m = None if fence else _cut_word(line)
        if not m:
            continue
        passed = False
        for j in range(i + 1, len(lines)):
            if not lines[j].strip() or j in edge:
                passed = True
                continue
            n = _STARTS.match(lines[j])
            if n and n[1][0].islower() | n[1][0].isdigit() | passed:
                if n[1][0].islower() or n[1][0].isdigit():
                    if reader.broken(m[1], n[1]):
                        yield i, j, m[1], n[1]
            break


def repair(text: str, reader: Reader, gone: set[int]) -> str:
    """Continuous paragraphs: without the furniture, broken words joined, misread letters put right.

    ``gone`` has the numbers of the lines that are furniture.  A text without
    scan noise comes back as it is.
    """
    lines = text.split("\n")
    broken = {i: (j, a, b) for i, j, a, b in _breaks(lines, gone, reader)}
    fixes: dict[int, list[tuple[int, int, str]]] = {}
    for i, at, n, good in _misread(lines, reader):
        if i not in gone:
            fixes.setdefault(i, []).append((at, n, good))
    if not (gone or broken or fixes):
        return text
    for i, own in fixes.items():
        for at, n, good in reversed(own):
            lines[i] = lines[i][:at] + good + lines[i][at + n :]
    # Paragraphs: a blank line ends one, unless furniture stands there amid a sentence.
    out: list[str] = []
    fence, glued, passed, blank = False, False, False, False
    for i, line in enumerate(lines):
        bare = line.strip()
        if i in gone or (not bare and not fence):
            passed, blank = passed or i in gone, blank or not bare
            continue
        marks = bare.startswith(("```", "~~~"))
        open_ = bool(out) and not _LISTED.match(out[-1]) and out[-1].strip() and out[-1].rstrip()[-1] not in _ENDS
        runs_on = glued or (
            bool(out) and not fence and not marks and not _LISTED.match(line) and not out[-1].startswith(("|", "`", "~", "#"))
            and (not blank or (passed and open_))
        )
        if runs_on:
            out[-1] += bare if glued or out[-1][-1:] in _HYPHENS else f" {bare}"
        else:
            if blank and out:
                out.append("")
            out.append(line.rstrip() if not fence else line)
        fence, glued, passed, blank = fence ^ marks, False, False, False
        if i in broken:
            out[-1], glued = out[-1].rstrip()[:-1], True
    return "\n".join(out)


def _shared_lexicon(texts: DataFrame, text: str):
    """The lexicon as a broadcast; at most 1 / SHARE words by the definition of a frequent word."""
    words = dict(lexicon(texts, text).collect())
    return texts.sparkSession.sparkContext.broadcast(words)


_EDGE_SCHEMA = "array<struct<line:int,fold:string,style:string,value:int,place:int>>"


def _examined(sections: DataFrame, shared, key: str, document: str, text: str) -> DataFrame:
    """(key, document, hyphen, chars, edge) of every text; a section of a null document is a document of its own."""
    kind = sections.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for pdf in batches:
            rows = [(k, d, *inspect(t, reader)) for k, d, t in pdf.itertuples(index=False)]
            edges = [[dict(zip(("line", "fold", "style", "value", "place"), c)) for c in r[4]] for r in rows]
            yield pd.DataFrame([(*r[:4], e) for r, e in zip(rows, edges)], columns=["key", "document", "hyphen", "chars", "edge"])

    own = F.coalesce(F.concat(F.lit("d"), F.col(document).cast("string")), F.concat(F.lit("k"), F.col(key).cast("string")))
    good = sections.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), own.alias("document"), F.col(text).alias("text"))
    return good.mapInPandas(run, f"key {kind}, document string, hyphen boolean, chars boolean, edge {_EDGE_SCHEMA}")


def _furniture(examined: DataFrame) -> DataFrame:
    """(key, line) of the lines that are furniture, by what their documents say.

    A page number is one that follows, or is followed by, another of its style
    in the order of the document's pages, or the only one of its style.  A
    title is furniture beside a page number, amid a sentence, or if its fold
    stands ``REPEATS`` times at page edges of the document, and the document
    has such a line or fewer than ``DOCUMENTS`` documents repeat the fold.
    """
    lines = examined.select("key", "document", F.inline("edge"))
    # One row per document, style and number: documents of many pages are spread over all tasks.
    at = F.struct("key", "line")
    numbers = lines.where("style <> ''").groupBy("document", "style", "value").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    after = numbers.select("document", "style", (F.col("value") - 1).alias("value"), F.col("last").alias("later"))
    followed = numbers.join(after, ["document", "style", "value"]).where(F.col("first") < F.col("later")).select("document", "style", "value")
    alone = numbers.groupBy("document", "style").agg(F.sum("n").alias("n"), F.max("value").alias("value")).where("n = 1").select("document", "style", "value")
    paged = followed.unionByName(followed.withColumn("value", F.col("value") + 1)).unionByName(alone).distinct()
    numbered = lines.where("style <> ''").join(paged, ["document", "style", "value"], "left_semi").select("key", "document", "line")
    titles = lines.where("style = ''")
    sure = titles.where(f"(place & {CUT + BESIDE}) <> 0").select("key", "document", "line")
    known = numbered.unionByName(sure)
    scanned = known.select("document").distinct()
    often = lines.where("fold <> ''").groupBy("document", "fold").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS).select("document", "fold")
    own = often.groupBy("fold").agg(F.count("*").alias("n")).where(F.col("n") < DOCUMENTS).select("fold")
    often = often.join(scanned, "document", "left_semi").unionByName(often.join(own, "fold", "left_semi").select("document", "fold")).distinct()
    repeated = titles.where("fold <> ''").join(often, ["document", "fold"], "left_semi").select("key", "document", "line")
    return known.unionByName(repeated).select("key", "line").distinct()


def noise(sections: DataFrame, key: str = "section_id", document: str = "input_id", text: str = "text") -> DataFrame:
    """(key, noise): one row per section and kind of noise (hyphen, chars, furniture) that its repair removes.

    Null texts and null keys have none.  Sections of a null document share no
    running headers.  Rows repeated with the same key count once.
    """
    examined = stage(_examined(sections.select(key, document, text).dropDuplicates(), _shared_lexicon(sections, text), key, document, text), "scans")
    kinds = [examined.where(k).select("key", F.lit(k).alias("noise")) for k in ("hyphen", "chars")]
    edge = _furniture(examined).select("key", F.lit("furniture").alias("noise"))
    return kinds[0].unionByName(kinds[1]).unionByName(edge).distinct().withColumnRenamed("key", key)


def repaired(sections: DataFrame, key: str = "section_id", document: str = "input_id", text: str = "text") -> DataFrame:
    """``sections`` with ``repaired``; a text without scan noise stays as it is, null stays null."""
    shared = _shared_lexicon(sections, text)
    gone = _furniture(stage(_examined(sections, shared, key, document, text), "scans")).groupBy("key").agg(F.collect_set("line").alias("__gone"))
    joined = sections.join(gone.withColumnRenamed("key", key), key, "left")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for pdf in batches:
            lines = [set(x) if x is not None else set() for x in pdf.pop("__gone")]
            pdf["repaired"] = [None if t is None else repair(t, reader, f) for t, f in zip(pdf[text], lines)]
            yield pdf

    from pyspark.sql import types as T

    return joined.select(*sections.columns, "__gone").mapInPandas(mend, T.StructType([*sections.schema.fields, T.StructField("repaired", T.StringType())]))


def repaired_items(sections: DataFrame, inputs: DataFrame) -> DataFrame:
    """(item_kind, item_id, input_id, text, repaired) of every section and every input; copies of a row count once.

    Each table has a lexicon and running headers of its own: sections are
    parts of inputs, so together every line and word would count twice.
    """
    s = sections.select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), "input_id", "text")
    i = inputs.select(F.lit("input").alias("item_kind"), F.col("input_id").alias("item_id"), "input_id", "text")
    s, i = (repaired(x.dropDuplicates(), "item_id") for x in (s, i))
    return s.unionByName(i)
