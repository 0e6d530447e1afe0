"""Repair of text from scanned pages.

Lines at the edges of a page are judged by a perceptron over their position and
form for furniture (running titles, stamps, page numbers), all lines by the
editor (editor.py) for words broken over lines and for misread words; what is
left is put together to paragraphs. Furniture of a chunk is what its pages'
furniture is. Both models are trained on weak labels of a bounded sample of the
scans themselves and applied to all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.editor import END, MARKS, START, Editor, Perceptron
from archivolt.llm.trie_join import segments, transposed
from archivolt.shared import cut, spread

#: A word is known if so many of the edited documents have it.
KNOWN_LEAST = 2
#: Known words that this share of the documents has are sent to all tasks; the rest are joined.
KNOWN_SHARE = 1e-4
#: Pages the models are trained on, about; they are applied to all.
TRAINING_PAGES = 4000
#: Lines without blanks at the top and foot of a page that may be furniture, and the length of the longest.
EDGE = 5
LONGEST = 90
#: Of these, the pages whose edges the model of furniture is trained on, about, and its rounds.
EDGE_PAGES, EDGE_ROUNDS = 4000, 8
#: Pages of a document from which on a line that isn't repeated counts as text for training.
TELLING_PAGES = 4

NUMBER = regex.compile(r"(?i)^\W*(?:(?:page|p\.?|pg\.?|seite|с\.?|стр\.?)\s*)?(\d{1,4}|[ivxlc]{1,8})(?:\s*[-—–\])])?\s*$")
TAIL = regex.compile(r"(?i)\s{2,}\W{0,2}(?:(?:page|p\.?)\s*)?(\d{1,4}|[ivxlc]{1,8})\W{0,2}$")
#: Forms of letterhead and entry marks; fixed values.
CONTENT = regex.compile(r"^\s*(?:(?:From|To|Date|No|Subject)\s*[.:]|p\.\s?\d+\s+\S.*:\s*$|No\. \d)")
MARK_SET = frozenset(MARKS)
TOKEN = regex.compile(r"[^\s—–/]+")
OUTER = regex.compile(r"^[^\p{L}\p{N}@$!|]+|[^\p{L}\p{N}@$|]+$")


def lexicon(documents: DataFrame, text: str, lang: str) -> tuple[dict[str, int], set[str], DataFrame]:
    """Known lower-case words with their document counts, which of them are English, and the known words that are too rare to be sent.

    All documents are counted, and a word of KNOWN_LEAST of them is known at any
    size of the collection. Those of a share of them come to the driver, so their
    number is at most the mean number of words of a document divided by that
    share; the rest stay a table (word), to be joined.
    """
    words = documents.select(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}])(\p{Ll}+(?:['’-]\p{Ll}+)*)(?![\p{L}\p{N}])"))).alias("w"), F.lower(F.substring(F.coalesce(F.col(lang), F.lit("")), 1, 2)).alias("l"))
    n = documents.where(F.col(text).isNotNull()).count()
    counted = words.select(F.explode("w").alias("w"), F.when(F.col("l") == "en", 1).otherwise(0).alias("en"), F.when(F.col("l").isin("ru", "fr", "de", "es"), 1).otherwise(0).alias("other")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("en").alias("en"), F.sum("other").alias("other"))
    counted = cut(counted.where(F.col("n") >= KNOWN_LEAST))
    rows = counted.where(F.col("n") >= KNOWN_SHARE * n).toPandas()
    english = rows[rows.en >= 3 * rows.other]
    return dict(zip(rows.w, rows.n.astype(int))), set(english.w), counted.where(F.col("n") < KNOWN_SHARE * n).select(F.col("w").alias("word"))


def _words(line: str) -> Iterator[tuple[str, int]]:
    for m in TOKEN.finditer(line):
        word = OUTER.sub("", m.group())
        if word.endswith(("'s", "’s")):
            word = word[:-2]
        if word:
            yield word, m.start()


def sampled(df: DataFrame, key: str, wanted: int = TRAINING_PAGES) -> DataFrame:
    """About ``wanted`` rows, a share of the hash values of their keys, so copies of one text aren't taken together."""
    share = min(1.0, wanted / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * share))


def trained(pages: DataFrame, key: str, text: str, known: dict[str, int]) -> Editor:
    """An editor trained on about TRAINING_PAGES pages."""
    sample = sampled(pages.where(F.col(text).isNotNull()).select(key, text), key).orderBy(key, text).toPandas()[text]
    odd: Counter = Counter()
    ends = []
    for body in sample:
        lines = body.split("\n")
        for i, line in enumerate(lines):
            end = END.search(line)
            if end and i + 1 < len(lines) and (start := START.match(lines[i + 1])):
                ends.append((end[1], end[2], start[1]))
            for word, at in _words(line):
                if word not in known and word[0] == word[0].lower() and not (end and at >= end.start(1)):
                    odd[word.lower()] += 1
    editor = Editor(known)
    editor.train(odd, ends)
    return editor


def core(line: str) -> str:
    """A line's furniture key: without a page number at its end, letters and digits only."""
    return regex.sub(r"[^\p{L}\p{N}]+", "", TAIL.sub("", line)).lower()


def edges(lines: list[str]) -> list[int]:
    """Numbers of the non-blank lines near the top and the foot."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return sorted({*full[:EDGE], *full[-EDGE:]})


EDGE_KIND = "array<struct<line_no:int,line:string,key:string,counts:boolean,top:int,foot:int,above:boolean,below:boolean,inward:string>>"


def edge_of(text: str) -> list[dict]:
    """The lines at the edges of a page with their places: what is told of them without the rest of the page.

    ``counts`` says that a line may be a repeated one; full lines of prose that
    two pages share are not furniture. ``above`` and ``below`` tell blank lines,
    ``inward`` is the next line towards the page's middle.
    """
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    got = []
    for n, i in enumerate(full):
        top, foot = n, len(full) - 1 - n
        if top >= EDGE and foot >= EDGE:
            continue
        line = lines[i]
        key, bare = core(line), line.strip()
        inward = n + 1 if top < foot or top == foot else n - 1
        got.append({
            "line_no": i, "line": line, "key": key if len(key) >= 4 and len(bare) < LONGEST and not CONTENT.match(line) else None,
            "counts": len(bare) < 60 and not regex.search(r"[.,;]\s*$", line) and not bare[0].islower() and bare[0] not in "[(",
            "top": top, "foot": foot, "above": i > 0 and not lines[i - 1].strip(), "below": i + 1 < len(lines) and not lines[i + 1].strip(),
            "inward": lines[full[inward]] if 0 <= inward < len(full) else None,
        })
    return got


def edge_lines(pages: DataFrame) -> DataFrame:
    """page_id, document_id, numbers (the page's own) and edge (see edge_of): all that furniture is told from.

    A page without a document is one of its own.
    """
    kind = f"page_id bigint, document_id bigint, numbers array<string>, edge {EDGE_KIND}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                numbers = {str(int(n)) for n in (r.page_seq, r.pdf_page_number) if n is not None and n == n} | set(regex.findall(r"\d+", r.logical_page_label or ""))
                rows.append((r.page_id, r.document_id, sorted(numbers), edge_of(r.raw_text)))
            yield pd.DataFrame(rows, columns=["page_id", "document_id", "numbers", "edge"])

    own = pages.where("raw_text is not null and page_id is not null")
    return spread(own.select("page_id", F.coalesce("document_id", -1 - F.col("page_id")).alias("document_id"), "page_seq", "pdf_page_number", "logical_page_label", "raw_text")).mapInPandas(run, kind)


def _share(text: str, test) -> int:
    return round(4 * sum(map(test, text)) / max(1, len(text)))


def line_features(e: dict, side: str, repeated: bool | None, numbers: set[str], outer: str) -> list[str]:
    """Position, form and letters of an edge line; ``repeated`` is None where the document is too short to tell."""
    line = e["line"]
    bare = line.strip()
    number = NUMBER.match(bare)
    at = e["top"] if side == "top" else e["foot"]
    place = f"{side}{at}"
    end = bare[-1] if not bare[-1].isalnum() else "a" if bare[-1].islower() else "A" if bare[-1].isupper() else "0"
    own = "none" if not number else "own" if number[1] in numbers else "digits" if number[1].isdigit() else "roman"
    words = len(bare.split())
    got = [
        "bias", place, f"rep{repeated}", f"rep{repeated}{place}", f"rep{repeated}{e['counts']}", f"number{own}", f"number{own}{side}{min(len(bare), 6)}", f"outer{outer}", f"outer{outer}{side}", f"tail{bool(TAIL.search(line))}",
        f"upper{_share(bare, str.isupper)}", f"digits{_share(bare, str.isdigit)}", f"lower{_share(bare, str.islower)}", f"words{min(words, 9)}", f"long{min(len(bare) // 10, 9)}", f"indent{min((len(line) - len(line.lstrip())) // 4, 4)}",
        f"end{end}", f"start{'l' if bare[0].islower() else 'u' if bare[0].isupper() else '0' if bare[0].isdigit() else bare[0]}", f"colon{':' in bare}", f"blank{e['above']}{e['below']}{side}", f"content{bool(CONTENT.match(line))}", f"full{len(bare) >= 0.7 * len((e['inward'] or '').strip())}{end == '.'}",
    ]
    if number:
        got += (f"shape{(shape := regex.sub(r'[0-9]+', '9', bare.lower()) if number[1].isdigit() else 'roman')}", f"shape{shape}{side}")
    form = f"{_share(bare, str.isupper)}{_share(bare, str.islower)}{min(words, 9)}{end}"
    got += (f"form{form}", f"form{form}{place}", f"{side}{min(at, 2)} start{bare[0].isupper()} end{end} {e['counts']}", f"rep{repeated} number{own} {e['counts']} {min(at, 2)}")
    letters = regex.sub(r"[^\p{L}]+", " ", bare.lower())[:60]
    return got + [f"g{letters[k : k + 4]}" for k in range(max(1, len(letters) - 3))]


TEXT, HEADER, PAGE_NUMBER = ("text",), ("header",), ("page_number",)


def _sides(edge: list[dict]) -> list[tuple[str, list[dict]]]:
    """The lines of each side from the outside in."""
    return [("top", sorted((e for e in edge if e["top"] < EDGE), key=lambda e: e["top"])), ("foot", sorted((e for e in edge if e["foot"] < EDGE), key=lambda e: e["foot"]))]


def weak_lines(edge: list[dict], repeated: set[str], numbers: set[str], pages: int) -> list[tuple[list[str], tuple]]:
    """Examples of one page: repeated lines are headers, the page's own number is one, other lines of long documents and lines behind those are text."""
    got = []
    for side, lines in _sides(edge):
        outer = "edge"
        for e in lines:
            number = NUMBER.match(e["line"].strip())
            if number and (number[1] in numbers or not number[1].isdigit() or number[1] != e["line"].strip()):
                truth = PAGE_NUMBER
            elif number:
                break
            elif e["counts"] and e["key"] in repeated:
                truth = HEADER
            elif pages >= TELLING_PAGES or CONTENT.match(e["line"]) or outer == "text":
                truth = TEXT
            else:
                break
            told = None if truth is PAGE_NUMBER else truth is HEADER
            got.append((line_features(e, side, told, numbers, outer), truth))
            if pages >= TELLING_PAGES or truth is not TEXT:  # the same as if the document were too short to tell
                got.append((line_features(e, side, None, numbers, outer), truth))
            outer = truth[0]
    return got


def page_furniture(edge: list[dict], repeated: set[str], numbers: set[str], pages: int, model: Perceptron) -> list[tuple[dict, str]]:
    """Edge lines that the model takes for ``header`` or ``page_number``, from the outside in up to the first text."""
    got: dict[int, tuple[dict, str]] = {}
    for side, lines in _sides(edge):
        outer, numbered = "edge", False
        for e in lines:
            there = e["key"] in repeated if e["key"] else False
            s = model.scores(line_features(e, side, True if there else False if pages >= TELLING_PAGES else None, numbers, outer))
            kind = max((TEXT, HEADER, PAGE_NUMBER), key=lambda c: s.get(c, 0.0))
            if kind is PAGE_NUMBER and (numbered or not NUMBER.match(e["line"].strip())) or kind is HEADER and len(e["line"].strip()) >= LONGEST:
                kind = TEXT
            if kind is TEXT:
                break
            numbered |= kind is PAGE_NUMBER
            got.setdefault(e["line_no"], (e, kind[0]))
            outer = kind[0]
    return list(got.values())


def _probes(key: str, sizes: list[int]) -> list[str]:
    """Where a segment of a string of one of the sizes can lie in the key, if two edits part them."""
    got = set()
    for size in sizes:
        d = len(key) - size
        if abs(d) <= 2:
            for k, (at, n) in enumerate(segments(size, 3)):
                for shift in range(-2, 3):
                    if abs(shift) + abs(d - shift) <= 2 and 0 <= at + shift and at + shift + n <= len(key):
                        got.add(f"{size} {k} {key[at + shift : at + shift + n]}")
    return sorted(got)


def _segments(key: str) -> list[str]:
    """The key's three segments; a swap of letters over their bounds counts for both sides, so it is tried undone."""
    got, parts = set(), segments(len(key), 3)
    for swaps in ([], [1], [2], [1, 2]):
        text = list(key)
        for b in swaps:
            at = parts[b][0]
            text[at - 1], text[at] = text[at], text[at - 1]
        got |= {f"{len(key)} {k} {''.join(text[at : at + n])}" for k, (at, n) in enumerate(parts)}
    return sorted(got)


def repeated_lines(edge: DataFrame) -> DataFrame:
    """document_id, key: keys of edge lines that are one that stands on at least two of the document's pages, or near it.

    Both sides are rows, however many keys a document has. Keys of eight letters
    and more meet on segments, one of which two edits leave whole, and are then
    compared.
    """
    keys = edge.select("document_id", "key").distinct()
    often = edge.where("counts").groupBy("document_id", "key").agg(F.count_distinct("page_id").alias("n")).where("n >= 2").select("document_id", "key")
    long = often.where(F.length("key") >= 8)
    sizes = long.groupBy("document_id").agg(F.collect_set(F.length("key")).alias("sizes"))  # bounded by the length of an edge line

    def spelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, k, s) for d, k, sizes in zip(f.document_id, f.key, f.sizes) for s in (_segments(k) if sizes is None else _probes(k, list(sizes)))]
            yield pd.DataFrame(rows, columns=["document_id", "key", "segment"])

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([transposed(x, y, 2) <= 2 for x, y in zip(a, b)], dtype=bool)

    kind = "document_id bigint, key string, segment string"
    none: Column = F.lit(None).cast("array<int>").alias("sizes")
    other = keys.where(F.length("key") >= 8).join(often, ["document_id", "key"], "left_anti").join(sizes, "document_id").where(F.exists("sizes", lambda n: F.abs(n - F.length("key")) <= 2))
    probes = other.select("document_id", "key", "sizes").mapInPandas(spelled, kind)
    whole = long.select("document_id", "key", none).mapInPandas(spelled, kind).withColumnRenamed("key", "often")
    met = probes.join(whole, ["document_id", "segment"]).select("document_id", "key", "often").distinct()
    return often.unionAll(met.where(near("often", "key")).select("document_id", "key").distinct())


class Reader:
    """Tells which tokens of lines hold an unknown lower-case word; remembers distinct tokens up to a bound."""

    def __init__(self, known: dict[str, int]):
        self.known, self.memo = known, {}
        self.spared: frozenset[str] = frozenset()  # rare known words of the text at hand

    def odd(self, word: str) -> bool:
        return word not in self.known and word not in self.spared and len(word) > 1 and word[0] == word[0].lower() and any(c.isalpha() for c in word)

    def any_odd(self, line: str) -> bool:
        memo = self.memo
        for token in line.split():
            got = memo.get(token)
            if got is None:
                if len(memo) > 500_000:
                    memo.clear()
                got = memo[token] = any(self.unknown(w) for w, _ in _words(token))
            if got and (not self.spared or any(self.odd(w) for w, _ in _words(token))):
                return True
        return False

    def unknown(self, word: str) -> bool:
        return word not in self.known and len(word) > 1 and word[0] == word[0].lower() and any(c.isalpha() for c in word)

    def all_unknown(self, text: str) -> set[str]:
        """Unknown lower-case words of a whole text."""
        got: set[str] = set()
        for token in text.split():
            if self.memo.get(token) is not False:
                words = {w for w, _ in _words(token) if self.unknown(w)}
                got |= words
                if len(self.memo) > 500_000:
                    self.memo.clear()
                self.memo[token] = bool(words)
        return got


def judge(lines: list[str], furniture: dict[int, str], editor: Editor, english: set[str], reader: Reader | None = None) -> tuple[list[tuple[int, str]], list[str], set[int]]:
    """(line, kind) of every finding, the lines with misread words repaired, and the lines that join the next."""
    found = [(i, kind) for i, kind in furniture.items()]
    fixed, joins = list(lines), set()
    known = editor.lexicon
    reader = reader or Reader(known)
    part_of: dict[int, tuple[int, str]] = {}  # line that starts with the rest of a broken word: (line of its start, half)
    for i, line in enumerate(lines):
        if i in furniture or line.rstrip()[-1:] not in MARK_SET or not (end := END.search(line)):
            continue
        j = i + 1
        while j < len(lines) and j in furniture:
            j += 1
        start = START.match(lines[j]) if j < len(lines) else None
        if start and editor.joined(end[1], end[2], start[1]):
            found.append((i, "hyphen"))
            joins.add(i)
            part_of[j] = (i, end[1])
    for i, line in enumerate(lines):
        if i in furniture or not reader.any_odd(line):
            continue
        words = list(_words(line))
        odd = [(w, at) for w, at in words if reader.odd(w)]
        sure = [w for w, _ in words if w in known]
        if sum(w in english for w in sure) * 2 < len(sure):
            continue
        bad = False
        tail = END.search(line)
        for word, at in odd:
            if i in joins and tail and at >= tail.start(1) - 1:
                continue
            if i in part_of and at == words[0][1]:
                above, half = part_of[i]
                whole = half + word
                if whole in known or whole.lower() == half.lower() + word and whole.capitalize() == whole:
                    continue
                got = editor.edit(whole)
                if got and got[0] in english:
                    found.append((above if got[1] < len(half) else i, "misread"))
                continue
            got = editor.edit(word)
            if got and got[0] in english:
                bad = True
                fixed[i] = fixed[i].replace(word, got[0])
        if bad:
            found.append((i, "misread"))
    return sorted(set(found)), fixed, joins


def paragraphs(lines: list[str], furniture: dict[int, str], joins: set[int]) -> str:
    """Lines put together: joined words, single blanks inside paragraphs, blank lines between them."""
    out, glue = [], ""
    for i, line in enumerate(lines):
        if i in furniture:
            continue
        body = line.strip()
        if not body:
            if out and out[-1] != "\n\n" and not (glue == ""):
                out.append("\n\n")
                glue = "\n\n"
            continue
        if glue == " " and out:
            out.append(" ")
        end = END.search(line) if i in joins else None
        out.append(line[: end.start(2)].strip() if end else body)
        glue = "" if end else " "
    return "".join(out).strip()


def spared(items: DataFrame, known: dict[str, int], rare: DataFrame) -> DataFrame:
    """item_table, item_id, spared: the words of each text that are known but too rare to be in the lexicon that is sent."""
    told = items.sparkSession.sparkContext.broadcast(known)  # bounded by the lexicon's share

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(told.value)
        for frame in frames:
            rows = [(t, i, w) for t, i, x in zip(frame.item_table, frame.item_id, frame.text) for w in reader.all_unknown(x)]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "word"])

    odd = items.where("text is not null").select("item_table", "item_id", "text").mapInPandas(run, "item_table string, item_id bigint, word string")
    return odd.join(rare, "word").groupBy("item_table", "item_id").agg(F.collect_set("word").alias("spared"))


def placed(lines: list[str], furniture, numbered: bool) -> dict[int, str]:
    """Line number to kind. Lines of a page are known by their numbers, those of a chunk by their text and the next line inward."""
    if numbered:
        return {f["line_no"]: f["kind"] for f in furniture if f["line_no"] < len(lines) and lines[f["line_no"]] == f["line"]}
    full = [i for i, line in enumerate(lines) if line.strip()]
    wanted: dict[str, list] = {}
    for f in furniture:
        wanted.setdefault(f["line"], []).append(f)
    got = {}
    for n, i in enumerate(full):
        for f in wanted.get(lines[i], ()):
            k = n + 1 if f["down"] else n - 1
            if not 0 <= k < len(full) or f["inward"] is None or lines[full[k]] == f["inward"]:
                got[i] = f["kind"]
                break
    return got


FURNITURE_KIND = "array<struct<line_no:int,line:string,kind:string,down:boolean,inward:string>>"


def repair(items: DataFrame, furniture: str | None, editor: Editor, english: set[str], texts: bool, rare: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """Findings (item_table, item_id, line_no, kind) or, with ``texts``, repaired texts (item_table, item_id, text).

    ``items``: item_table, item_id, text and, where named, a column with the
    furniture (FURNITURE_KIND), whose line numbers are those of the text if
    ``numbered``. ``rare`` has known words beside the editor's lexicon. Null texts
    give nothing, empty ones an empty text; whole texts are read. Repeated rows
    give repeated findings.
    """
    spark = items.sparkSession
    told = spark.sparkContext.broadcast((editor, english))  # bounded by the lexicon's share
    kind = "item_table string, item_id bigint, " + ("text string" if texts else "line_no int, kind string")
    own = items.where("text is not null").select("item_table", "item_id", "text", F.col(furniture).alias("furniture") if furniture else F.lit(None).cast(FURNITURE_KIND).alias("furniture"))
    own = own.withColumn("spared", F.lit(None).cast("array<string>")) if rare is None else own.join(spared(own, editor.lexicon, rare), ["item_table", "item_id"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, words = told.value
        reader = Reader(e.lexicon)
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                lines = row.text.split("\n")
                there = {} if row.furniture is None else placed(lines, row.furniture, numbered)
                reader.spared = frozenset() if row.spared is None else frozenset(row.spared)
                found, fixed, joins = judge(lines, there, e, words, reader)
                if texts:
                    rows.append((row.item_table, row.item_id, paragraphs(fixed, there, joins)))
                else:
                    rows += [(row.item_table, row.item_id, i, k) for i, k in found]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "text"] if texts else ["item_table", "item_id", "line_no", "kind"])

    return own.select("item_table", "item_id", "text", "furniture", "spared").mapInPandas(run, kind)


def furniture_of(pages: DataFrame) -> DataFrame:
    """page_id and furniture (FURNITURE_KIND) of every page with any.

    Only the lines at the edges are compared between pages; the model that judges
    them is trained on about EDGE_PAGES pages.
    """
    edge = cut(edge_lines(pages))
    again = repeated_lines(edge.select("document_id", "page_id", F.inline("edge")).where("key is not null").select("document_id", "page_id", "key", "counts"))
    # a page carries the repeated keys among its own edge lines only
    keys = edge.select("document_id", "page_id", F.explode(F.array_distinct(F.filter(F.transform("edge", lambda e: e["key"]), lambda k: k.isNotNull()))).alias("key"))
    there = keys.join(again, ["document_id", "key"]).groupBy("document_id", "page_id").agg(F.collect_set("key").alias("repeated"))
    counts = edge.groupBy("document_id").agg(F.countDistinct("page_id").alias("pages"))
    rows = cut(edge.join(there, ["document_id", "page_id"], "left").join(counts, "document_id").select("page_id", "numbers", "edge", F.coalesce("repeated", F.array().cast("array<string>")).alias("repeated"), "pages"))
    model = Perceptron()
    model.train(rounds=EDGE_ROUNDS, examples=[x for r in sampled(rows, "page_id", EDGE_PAGES).orderBy("page_id").collect() for x in weak_lines([e.asDict() for e in r.edge], set(r.repeated), set(r.numbers), r.pages)])
    told = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                got = page_furniture(list(r.edge), set(r.repeated), set(r.numbers), r.pages, told.value)
                if got:
                    out.append((r.page_id, [{"line_no": e["line_no"], "line": e["line"], "kind": k, "down": e["top"] <= e["foot"], "inward": e["inward"]} for e, k in got]))
            yield pd.DataFrame(out, columns=["page_id", "furniture"])

    return rows.mapInPandas(run, f"page_id bigint, furniture {FURNITURE_KIND}")
