"""BPE encoding and decoding by a trie of distinct words.

In BPE the encoding of a word is fixed by the last token of each of its prefixes: token t can end a prefix if what
stands before t is a prefix whose own last token s keeps its place next to t, that is, if no merge
of their symbols would have crossed the border between them. So the distinct words of a batch are walked in sorted order, which is a depth-first walk of their
trie; the stack holds the last token of each prefix on the path, and a prefix that many words share is worked out once.
A word's last symbol carries the end-of-word mark, so it gets a state of its own beside the shared ones.

Text rules are those of the tokenizer file: special tokens are cut out of the raw text first; NFC; white space to
a space; lower case a character at a time; words by the file's pattern; UTF-8 bytes as the byte-level alphabet. What is
a letter, a number or a capital is asked of the tokenizer's own library for the code points that this Python does not know.
One pass without a shuffle: each task keeps the words it has met, at most CACHE of them.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 400_000
#: Latin letters and all common signs of western texts lie below this code point.
NEAR = 0x250
BATCH_CHARS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the others take code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def token_table(config: dict) -> dict[int, str]:
    return {i: t for t, i in config["model"]["vocab"].items()} | {x["id"]: x["content"] for x in config["added_tokens"]}


@functools.cache
def unicode_gaps() -> dict[str, dict[int, str]]:
    """lower: what the tokenizers library lower-cases and this Python, which has not assigned it, does not.

    shape: for each unassigned code point that the regex module classes otherwise than the library a stand-in of the
    library's class, a letter that no contraction has, a number or a symbol. Nothing else differs: all code points agree in NFC.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    unknown = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn"]
    low = normalizers.Lowercase().normalize_str("\n".join(unknown)).split("\n")
    of_class = lambda name: set("".join(x for x, _ in pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "removed", invert=True).pre_tokenize_str("".join(unknown))))
    letters, numbers = of_class("L"), of_class("N")
    theirs = lambda c: "x" if c in letters else "1" if c in numbers else "\xa4"
    own = regex.compile(r"(\p{L})|(\p{N})|.", regex.DOTALL)
    ours = lambda c: ("\xa4", "x", "1")[own.match(c).lastindex or 0]
    return {"lower": {ord(c): x for c, x in zip(unknown, low, strict=True) if c != x}, "shape": {ord(c): theirs(c) for c in unknown if theirs(c) != ours(c)}}


def _char_class(codes: Iterable[int]) -> re.Pattern:
    """A pattern of one of these code points."""
    spans: list[list[int]] = []
    for c in sorted(codes):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]") if spans else re.compile(r"(?!)")


def _near_pattern(pattern: str) -> re.Pattern:
    """The file's pattern for texts below NEAR alone, with its classes written out: Python's own engine is twice as fast."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        of_class = regex.compile(name)
        pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(NEAR) if of_class.match(chr(c))))
    return re.compile(pattern)


class WordBpe:
    """A tokenizer file of this kind: BPE with an end-of-word suffix over the byte-level alphabet, no decoder."""

    def __init__(self, config: dict):
        model = config["model"]
        if model["type"] != "BPE" or config["decoder"] or not model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError("not a byte-level BPE file with word ends")
        self.suffix = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.ids = dict(model["vocab"])
        self.tokens = token_table(config)
        alphabet = byte_alphabet()
        self.bytes = dict(enumerate(alphabet))
        #: token -> the rank of the merge that forms it (-1: a symbol), and its two parts
        self.formed = {s: (-1, "", "") for c in alphabet for s in (c, c + self.suffix)}
        for i, (a, b) in enumerate(pairs):
            self.formed.setdefault(a + b, (i, a, b))
        #: tokens spelled backwards, as nested tables by character, "" marking one's end; those with the suffix apart
        self.backwards: tuple[dict, dict] = ({}, {})
        for token in self.formed:
            bare = token.removesuffix(self.suffix)
            node = self.backwards[len(bare) < len(token)]
            for c in reversed(bare):
                node = node.setdefault(c, {})
            node[""] = token
        self.keeps: dict[tuple[str, str], bool] = {}
        self.reset_words()
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in config["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.near, self.beyond = _near_pattern(self.pattern.pattern), re.compile(f"[{chr(NEAR)}-{chr(sys.maxunicode)}]")
        gaps = config["gaps"]
        self.lower, self.shape, self.odd = gaps["lower"], gaps["shape"], _char_class({*gaps["lower"], *gaps["shape"]})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def keep(self, a: str, b: str) -> bool:
        if len(self.keeps) > CACHE:
            self.keeps.clear()
        out = self.keeps[a, b] = self.stays(a, b)
        return out

    def stays(self, a: str, b: str) -> bool:
        """Goes back in time over the merges beside the border between a and b.

        Whichever of the two bordering tokens was formed later is undone; a merge across the border would have had to
        come before that one. Equal ranks merge from the left, so a merge inside b loses against one across at its rank.
        """
        limit, formed, rank = len(self.rank), self.formed, self.rank
        while True:
            if rank.get((a, b), limit) < limit:
                return False
            (of_a, _, tail), (of_b, head, _) = formed[a], formed[b]
            if of_a > of_b:
                a, limit = tail, of_a
            elif of_b >= 0:
                b, limit = head, of_b + 1
            else:
                return True

    def reset_words(self) -> None:
        """An empty table of words: word -> its number, and all words' ids end to end."""
        self.words = {s: k for k, s in enumerate(self.special)}
        self.flat, self.ends = array("i", self.special.values()), array("q", range(len(self.special) + 1))

    def encode_words(self, words: Iterable[str]) -> None:
        """Add distinct words to the table, in one depth-first walk of their byte-level spellings.

        tokens[d] and befores[d] are the last token of the path's first d symbols and where it begins.
        """
        ids, flat, ends, number = self.ids, self.flat, self.ends, len(self.words)
        path, tokens, befores = "", [""], [0]
        for word, raw in sorted((w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.bytes), w) for w in words):
            n = len(word)
            shared, most = 0, min(len(path), n - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del tokens[shared + 1 :], befores[shared + 1 :]
            for d in range(shared + 1, n):
                token, d = self.last_token(word, d, 0, tokens)
                tokens.append(token)
                befores.append(d)
            path = word[:-1]
            token, d = self.last_token(word, n, 1, tokens)
            out = [ids[token]]
            while d:
                out.append(ids[tokens[d]])
                d = befores[d]
            out.reverse()
            flat.extend(out)
            ends.append(len(flat))
            self.words[raw] = number
            number += 1

    def last_token(self, word: str, d: int, marked: int, tokens: list[str]) -> tuple[str, int]:
        """The last token of word[:d], with the suffix if marked, and where it begins: the one that what stands before leaves alone."""
        node, found, at = self.backwards[marked], [], d
        while at:
            node = node.get(word[at - 1])
            if node is None:
                break
            at -= 1
            if "" in node:
                found.append((node[""], at))
        keeps = self.keeps
        for token, at in reversed(found):
            if not at:
                return token, 0
            before = tokens[at]
            stay = keeps.get((before, token))
            if stay is None:
                stay = self.keep(before, token)
            if stay:
                return token, at
        raise AssertionError(f"no token ends {word[:d]!r}")

    def pretokens(self, text: str) -> list[str]:
        """The words of a text without special tokens. Capital sigma is lowered apart: str.lower looks at its neighbours."""
        if text.isascii():
            return self.near.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("\u03a3", "\u03c3")
        low = text.lower()
        if not self.beyond.search(low):
            return self.near.findall(low)
        if not self.odd.search(text):
            return self.pattern.findall(low)
        # words are found in a text of the same length with a stand-in for each code point that is classed otherwise
        low = text.translate(self.lower).lower()
        return [low[m.start() : m.end()] for m in self.pattern.finditer(low.translate(self.shape))]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin and end. Each distinct word is worked out once."""
        pieces = [self._pieces(t or "") for t in texts]
        new = set(chain.from_iterable(pieces)).difference(self.words)
        if len(self.words) + len(new) > CACHE:
            self.reset_words()
            new = set(chain.from_iterable(pieces)).difference(self.words)
        self.encode_words(new)
        counts = np.array([len(p) for p in pieces], np.int64)
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        flat, ends = np.frombuffer(self.flat, np.int32).copy(), np.frombuffer(self.ends, np.int64).copy()
        begin, n = ends[number], ends[number + 1] - ends[number]
        after = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin - after[:-1], n) + np.arange(after[-1])]
        return ids, after[np.concatenate([[0], np.cumsum(counts)])]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _pieces(self, text: str) -> list[str]:
        """Words and special tokens. A special token is no lower-case word, so the two can share a table."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pretokens(text)
        return [c for i, part in enumerate(self.split_special.split(text)) for c in ([part] if i % 2 else self.pretokens(part))]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as a file without a decoder has it; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most BATCH_CHARS characters, or one row."""
    start, held = 0, 0
    for i, n in enumerate(x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)):
        if held and held + n > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def load(path: str) -> dict:
    """The tokenizer file, and under gaps what unicode_gaps says."""
    with open(path, encoding="utf-8") as f:
        return json.load(f) | {"gaps": unicode_gaps()}


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ids (array of int); a column of this name is replaced, all others stay.

    A null text encodes as an empty one, to no ids. Texts of any length are encoded whole. Repeated rows stay.
    tokenizer is a file that the driver reads; tasks get its contents by broadcast.
    """
    config, kept = docs.sparkSession.sparkContext.broadcast(load(tokenizer)), [c for c in docs.columns if c != ids]
    source = docs.select(*kept, F.col(text).alias("__text"))

    def task(batches):
        bpe = WordBpe(config.value)
        for whole in batches:
            for batch in _parts(whole, len(kept)):
                flat, ends = bpe.encode_flat(batch.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], [*kept, ids])

    return source.mapInArrow(task, source.drop("__text").schema.add(ids, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the decoded text instead of the ids; null ids decode to an empty text."""
    known_tokens, kept = encoded.sparkSession.sparkContext.broadcast(token_table(load(tokenizer))), [c for c in encoded.columns if c not in (ids, text)]
    source = encoded.select(*kept, ids)

    def task(batches):
        table = known_tokens.value
        names = pa.array([table.get(i) for i in range(max(table) + 1)], pa.string())
        for batch in batches:
            column = batch.column(len(kept))
            known = pc.if_else(pc.and_(pc.greater_equal(column.flatten(), 0), pc.less(column.flatten(), len(names))), column.flatten(), None)
            tokens, ends = names.take(known), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), tokens)
            if tokens.null_count:
                lists = pa.array([[t for t in x if t is not None] for x in lists.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pc.binary_join(lists, " ")], [*kept, text])

    return source.mapInArrow(task, source.drop(ids).schema.add(text, "string"))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs (doc_id, text), through encode and decode."""
    coded = encode(docs.select("doc_id", "text"), tokenizer).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    return decode(coded, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_tokenizer())
