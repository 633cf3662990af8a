"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's windows.

Words of the benchmark are numbered; a text becomes a string of the spelled numbers (with
fillers for words that the benchmark does not have), and the automaton over the windows
of all items reads it once. A match ends at a word, and words keep their byte offsets in the original
text.

An automaton has a bounded number of nodes. A benchmark that needs more is dealt into
rounds, each with an automaton of its own: the hits of a round are written, its
automaton goes, and at the end the rounds' hits are merged for each text.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.kernels import slices
from sparkloom.llm.session import written

#: Words of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of the alphabet of a place in a word's number.
DIGITS = 64
#: Words of windows that one automaton has at most, a few nodes of 60 bytes each; a larger benchmark is read in several rounds over the documents.
ROUND_NODES = 1 << 20
#: Words of an item that are dealt together; a longer one is cut into pieces that overlap by a window less a word.
PIECE_WORDS = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    """The words; only A-Z are lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Aho-Corasick over the windows of some items: [(item index, text)].

    A word's number is spelled in as many letters as the largest needs, of DIGITS to a
    place; every place has an alphabet of its own, so a match begins and ends with words,
    and no node has more than DIGITS children to search.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        words = [(item, words_of(text)) for item, text in items]
        distinct = dict.fromkeys(w for _, own in words for w in own)
        self.width = 1
        while DIGITS**self.width < len(distinct):
            self.width += 1
        places = range(self.width)
        self.letters = {w: "".join(chr(1 + p * DIGITS + k // DIGITS**p % DIGITS) for p in places) for k, w in enumerate(distinct)}
        self.filler = "\x00" * self.width
        owners: dict[str, set[int]] = {}
        for item, own in words:
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault("".join([self.letters[w] for w in own[k : k + window]]), set()).add(item)
        self.machine = ahocorasick.Automaton()
        for key, who in owners.items():
            self.machine.add_word(key, (len(key) // self.width, tuple(sorted(who))))
        if owners:
            self.machine.make_automaton()
        self.any = bool(owners)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges [start, end) inside occurrences, merged, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.any and found:
            get, filler = self.letters.get, self.filler
            for last, (size, who) in self.machine.iter("".join([get(w, filler) for w in found])):
                end = (last + 1) // self.width
                items.update(who)
                start = end - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))
        return spans, items


_built: dict[str, Automaton] = {}


_SPAN = ("first_word", "last_word", "start", "end")
_SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in _SPAN]))
_SPANS_SQL = "array<struct<first_word:long,last_word:long,start:long,end:long>>"


def _scan(shared, window: int, key: str, only_hits: bool):
    """shared: broadcast [(item_id, text)]. Adds n_words, spans and items to the columns before the text, for all texts or those with hits."""

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = Automaton([(k, text) for k, (_, text) in enumerate(shared.value)], window)
        machine, names = _built[key], [name for name, _ in shared.value]
        for batch in (part for whole in batches for part in slices(whole, 512)):
            n_words, spans, owners, keep = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = words_of(text)
                ranges, who = machine.scan(found)
                if only_hits and not ranges:
                    continue
                at = [m.span() for m in WORD.finditer(text.encode("utf-8", "surrogatepass").lower())] if ranges else []
                spans.append([{"first_word": a, "last_word": b - 1, "start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
                n_words.append(len(found)), keep.append(k)
                owners.append(sorted({names[i] for i in who} - {None}))
            kept = batch.take(pa.array(keep, pa.int64()))
            head = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[kept.column(c) for c in head], pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(owners, pa.list_(pa.string()))], names=[*head, "n_words", "spans", "items"]
            )

    return run


def _merged(spans):
    """Spans, in order, with those that touch or overlap made one."""

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first_word"].alias("first_word"), F.greatest(last["last_word"], s["last_word"]).alias("last_word"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last_word"] + 1 >= s["first_word"])
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS_SQL), add)


class Decontamination:
    """Finds windows of `window` consecutive benchmark words in documents.

    Texts are lower-cased in A-Z only. An item with fewer words than a window, but at
    least one, is a window as a whole. Null and empty texts have no words and match
    nothing; a null item_id is left out of the items but its windows count as hits.
    Repeated documents are scanned one by one, equal items count by their item_id.
    Empty tables give no rows, or no hits. Further columns are ignored.

    The benchmark goes to the executors in rounds of about ROUND_NODES nodes at most;
    documents are read once a round. Where spans touch they are one span.
    """

    def __init__(self, window: int = 10):
        if window < 1:
            raise ValueError("a window has at least one word")
        self.window = window

    def _rounds(self, benchmark: DataFrame) -> list[DataFrame]:
        """Frames (item, text), each for one automaton."""
        words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(_SQL_WORD), F.lit(0))
        bench = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
        bench = bench.select("item", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - self.window + 1) / PIECE_WORDS) - 1, F.lit(0)).cast("int"))).alias("piece"), "words")
        bench = bench.select("item", F.slice("words", F.col("piece") * PIECE_WORDS + 1, F.lit(PIECE_WORDS + self.window - 1)).alias("words"))
        size = F.size("words")
        nodes = bench.agg(F.coalesce(F.sum(F.greatest(size - self.window + 1, F.lit(1)) * F.least(size, F.lit(self.window))), F.lit(0)).alias("n")).first()["n"]
        texts = bench.select("item", F.concat_ws(" ", "words").alias("text"))
        if nodes <= ROUND_NODES:
            return [texts]
        rounds = -(-5 * nodes // (4 * ROUND_NODES))
        return [texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == k) for k in range(rounds)]

    def _scanned(self, own: DataFrame, items: DataFrame, only_hits: bool) -> tuple[DataFrame, object]:
        rows = [(r["item"], r["text"]) for r in items.orderBy("item", "text").collect()]  # words of about ROUND_NODES nodes at most
        key = hashlib.sha256(repr((self.window, rows)).encode("utf-8", "surrogatepass")).hexdigest()
        shared = own.sparkSession.sparkContext.broadcast(rows)
        head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text")
        return own.mapInArrow(_scan(shared, self.window, key, only_hits), f"{head}, n_words long, spans {_SPANS_SQL}, items array<string>"), shared

    def run(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """(doc_id, n_words, spans, items): merged spans of hit words with byte offsets in the UTF-8 text, and the items found, sorted."""
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rounds = self._rounds(benchmark)
        if len(rounds) == 1:
            return self._scanned(own, rounds[0], False)[0]
        keyed = own.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")  # hits belong to a text, whichever row has it
        found = None
        for items in rounds:
            hits, shared = self._scanned(keyed.drop("doc_id"), items, True)
            hits = written(hits.select("text_md5", "spans", "items").groupBy("text_md5").agg(F.min("spans").alias("spans"), F.min("items").alias("items")))
            shared.destroy()
            found = hits if found is None else found.unionByName(hits)
        merged = found.groupBy("text_md5").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # an entry for each round at most
        n_words = F.coalesce(F.regexp_count(F.translate("text", _UPPER, _LOWER), F.lit(_SQL_WORD)), F.lit(0)).cast("long")
        return keyed.select("doc_id", "text_md5", n_words.alias("n_words")).join(merged, "text_md5", "left").select(
            "doc_id", "n_words", F.coalesce("spans", F.array().cast(_SPANS_SQL)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
