"""BPE by distinct-word tables.

Spark splits the texts of a part (one task's, one after another until PART_CHARS) into the tokenizer's words; a text becomes
the numbers of its words in its part's list, small numbers for frequent words. The lists are dealt by word, each distinct
word is encoded once, the ids go back to the lists, and each part's texts take theirs by position; ids become text again
by an id-to-piece table. Lists and numbers travel packed, so what moves is each part's distinct words and about a byte and
a half for each word of text. Splitting has two ways with equal results: patterns over explicit Latin-1 classes for texts
that fit Latin-1 (where NFC changes nothing), and the tokenizers library's own normaliser and pre-tokeniser for all others.

WordTable is the same table inside one worker, bounded, for operators that need ids of whole texts as they come.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, give_back, map_documents, with_columns

#: Words a worker's table holds at most; a full table is emptied.
TABLE_WORDS = 300_000
#: Characters of text that share one list of distinct words; texts whose numbers are packed together.
PART_CHARS, ROW_TEXTS = 1 << 25, 512
#: Characters of text whose prefix tables a worker holds at once.
TABLE_CHARS = 1 << 19
#: Bits of a token id in a pair of ids.
ID_BITS = 20
_LAST = itemgetter(-1)
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES, _DIGITS = r"\t-\r \x85\xa0", "0-9²³¹¼-¾"
_LOWER = "a-zªµºß-öø-ÿ"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_WORD_SPLIT = re.compile(f"{_CONTRACTIONS}|[{_LOWER}]+|[{_DIGITS}]|[^{_SPACES}{_LOWER}{_DIGITS}]+")
_BYTE_SPLIT = re.compile(f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Whitespace of the byte tokenizer's split, first characters of words that a prefix may split otherwise, contractions of over two characters.
_ALL_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_FIRST = frozenset("\0\t\n\x0b\x0c\r \x85\xa0'")
_LONG_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTER = byte_letters()
_BYTE = {c: b for b, c in enumerate(_LETTER)}


class WordTable(dict):
    """Split words of a text -> their ids as little-endian bytes. ``words`` splits, ``ids`` joins by position."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.lower = self.tok.normalizer is not None
        self.split = _WORD_SPLIT if self.lower else _BYTE_SPLIT
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.hint = min((s[:2] for s in self.special), default="\0")

    def encode(self, word: str) -> bytes:
        """Ids of one split word, or of a special token behind two NULs."""
        if word.startswith("\0\0"):
            return self.special[word[2:]]
        mapped = word[1:] if word[0] == "\0" else "".join(_LETTER[b] for b in word.encode())
        return np.array([t.id for t in self.tok.model.tokenize(mapped)], "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = got = self.encode(word)
        return got

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """Stretches of text and special tokens in it: (is special, string)."""
        if self.hint not in text:
            yield False, text
            return
        for k, part in enumerate(self.at_special.split(text)):
            if part:
                yield k % 2 == 1, part

    def words(self, part: str) -> list[str]:
        """Split words; those of the library's own way are already byte letters and begin with NUL."""
        try:
            part.encode("latin-1")
            if "\0" not in part:
                return self.split.findall(part.lower() if self.lower else part)
        except UnicodeEncodeError:
            pass
        if self.lower:
            part = self.tok.normalizer.normalize_str(part)
        return ["\0" + w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text, 4 bytes each."""
        if len(self) > TABLE_WORDS:
            self.clear()
        out = []
        for special, part in self.parts(text or ""):
            out += [self.special[part]] if special else map(self.__getitem__, self.words(part))
        return b"".join(out)

    def pieces(self) -> list[bytes]:
        """UTF-8 of each id as the library's decode writes it (no decoder: pieces are joined by spaces)."""
        n = self.tok.get_vocab_size(with_added_tokens=True)
        return [(self.tok.id_to_token(i) or "").encode() for i in range(n)]


def _tables(path: str, cache: dict = {}) -> WordTable:  # noqa: B006  a worker keeps its table over tasks
    if path not in cache:
        cache[path] = WordTable(path)
    return cache[path]


class Numbers(dict):
    """Word -> its number, in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, compressed: the upper planes of small numbers are nearly nothing."""
    return squeeze(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


_SPLIT = ["part", "doc_ids", "lengths", "numbers", "bucket", "sizes", "words"]


def _numbered(path: str, buckets: int):
    """Rows (part, doc_ids, lengths, numbers) of ROW_TEXTS texts and (part, numbers, bucket, sizes, words) of a part's
    distinct words, by number; these numbers are differences."""

    def close(part: int, texts: list[tuple], known: Numbers) -> Iterator[pd.DataFrame]:
        flat = np.concatenate([n for _, n in texts]) if texts else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")  # frequent words first
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        rows = []
        for a in range(0, len(texts), ROW_TEXTS):
            some = texts[a : a + ROW_TEXTS]
            rows.append((part, [d for d, _ in some], pack(np.array([len(n) for _, n in some])), pack(rank[np.concatenate([n for _, n in some])]), None, None, None))
        words = [w.encode() for w in known]
        words = [words[i] for i in order.tolist()]
        dealt = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
        for b in np.unique(dealt).tolist():
            own = np.flatnonzero(dealt == b)
            mine = [words[i] for i in own.tolist()]
            rows.append((part, None, None, pack(np.diff(own, prepend=0)), b, pack(np.array([len(w) for w in mine])), squeeze(b"".join(mine))))
        yield pd.DataFrame(rows, columns=_SPLIT).astype({"bucket": "Int32"})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, part = _tables(path), TaskContext.get().partitionId() << 32
        texts, size, known = [], 0, Numbers()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if size > PART_CHARS:
                    yield from close(part, texts, known)
                    part, texts, size, known = part + 1, [], 0, Numbers()
                numbers: list[int] = []
                for special, piece in table.parts(text or ""):
                    numbers += map(known.__getitem__, ["\0\0" + piece] if special else table.words(piece))
                texts.append((doc_id, np.array(numbers, np.uint32)))
                size += len(text or "")
        if texts:
            yield from close(part, texts, known)

    return run


def _encode_lists(path: str):
    """Lists of words, sorted by bucket -> the same with each word's ids; a word of a bucket is encoded once."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bucket, known = _tables(path), None, {}
        for pdf in batches:
            rows = []
            for part, b, numbers, sizes, words in zip(pdf["part"], pdf["bucket"], pdf["numbers"], pdf["sizes"], pdf["words"], strict=True):
                if b != bucket:
                    bucket, known = b, {}
                text, at, got = expand(words), 0, []
                for n in unpack(sizes).tolist():
                    w = text[at : at + n]
                    at += n
                    if w not in known:
                        known[w] = table.encode(w.decode())
                    got.append(known[w])
                rows.append((part, numbers, pack(np.array([len(g) // 4 for g in got])), pack(np.frombuffer(b"".join(got), "<u4"))))
            yield pd.DataFrame(rows, columns=["part", "numbers", "sizes", "ids"])

    return run


def _encoded(documents: DataFrame, path: str, finish: Callable, schema: str) -> DataFrame:
    """finish(doc_ids, numbers, ids) for each part: rows of ``schema`` from its texts' word numbers and its words' ids."""
    scratch = Scratch(documents.sparkSession)
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = with_columns(documents, doc_id="long", text="string")
    split = scratch.keep(map_documents(docs, _numbered(path, buckets), "part long, doc_ids array<string>, lengths binary, numbers binary, bucket int, sizes binary, words binary"), "split")
    lists = split.where("bucket is not null").select("part", "bucket", "numbers", "sizes", "words")
    back = lists.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_encode_lists(path), "part long, numbers binary, sizes binary, ids binary")

    def of_part(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        places = [np.cumsum(unpack(n), dtype=np.int64) for n in right["numbers"]]
        ids: list = [None] * sum(map(len, places))
        for own, sizes, packed in zip(places, right["sizes"], right["ids"], strict=True):
            flat, cuts = unpack(packed), np.cumsum(unpack(sizes)).tolist()
            for k, a, b in zip(own.tolist(), [0, *cuts[:-1]], cuts, strict=True):
                ids[k] = flat[a:b]
        numbers = [n for lengths, own in zip(left["lengths"], left["numbers"], strict=True) for n in np.split(unpack(own), np.cumsum(unpack(lengths))[:-1])]
        out = finish([d for ds in left["doc_ids"] for d in ds], numbers, ids)
        give_back()
        return out

    carried = schema.replace("doc_id long", "doc_id string")
    texts = split.where("bucket is null").select("part", "doc_ids", "lengths", "numbers")
    out = texts.groupBy("part").cogroup(back.groupBy("part")).applyInPandas(of_part, carried)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _joined(numbers: np.ndarray, words: list[bytes]) -> bytes:
    """The words of these numbers, by position, with a space between; words without ids are empty and leave none."""
    return b" ".join([w for k in numbers.tolist() if (w := words[k])])


def bpe_encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: whole texts encoded and decoded (special tokens kept).

    The word tokenizer's file names no decoder, so decoding writes its pieces with a space between. Null is the empty text:
    no ids, empty decoding. Repeated rows stay, other columns are ignored; an empty table gives no rows. A part's texts
    are in one task; a text longer than PART_CHARS is a part's last."""
    pieces = documents.sparkSession.sparkContext.broadcast(WordTable(path).pieces())

    def finish(doc_ids: list, numbers: list[np.ndarray], ids: list[np.ndarray]) -> pd.DataFrame:
        words = [b" ".join([pieces.value[i] for i in own.tolist()]) for own in ids]
        encoded = [np.concatenate([ids[k] for k in own.tolist()] or [np.zeros(0, "<u4")]).astype(np.int32) for own in numbers]
        return pd.DataFrame({"doc_id": doc_ids, "ids": encoded, "decoded": [_joined(own, words).decode() for own in numbers]})

    return _encoded(documents, path, finish, "doc_id long, ids array<int>, decoded string")


def bpe_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as bpe_encode_decode, with digests in place of the long columns."""
    pieces = documents.sparkSession.sparkContext.broadcast(WordTable(path).pieces())
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def finish(doc_ids: list, numbers: list[np.ndarray], ids: list[np.ndarray]) -> pd.DataFrame:
        size = np.array([len(own) for own in ids], np.int64)
        words = [b" ".join([pieces.value[i] for i in own.tolist()]) for own in ids]
        decimal = [b" ".join([b"%d" % i for i in own.tolist()]) for own in ids]
        out = {"n_tokens": [int(size[own].sum()) if len(own) else 0 for own in numbers]}
        out |= {"ids_sha256": [sha(_joined(own, decimal)) for own in numbers], "decoded_sha256": [sha(_joined(own, words)) for own in numbers]}
        return pd.DataFrame({"doc_id": doc_ids} | out)

    return _encoded(documents, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class Neighbours(dict):
    """first id << ID_BITS | second id -> whether the library encodes their joined text as just these two."""

    def __init__(self, tok: Tokenizer, texts: list[str]):
        super().__init__()
        self.tok, self.texts = tok, texts

    def __missing__(self, pair: int) -> bool:
        a, b = self.texts[pair >> ID_BITS], self.texts[pair & ((1 << ID_BITS) - 1)]
        got = self[pair] = [t.value for t in self.tok.model.tokenize(a + b)] == [a, b]
        return got


class PrefixTable(dict):
    """Split word -> token counts of all its byte prefixes, by dynamic programming over last tokens.

    Byte-pair encodings have this property: a token sequence is the encoding of its text exactly if each
    neighbouring pair is the encoding of that pair's text. So the last token of a prefix is the one suffix
    in the vocabulary that goes with the last token of the prefix before it, and counts add up by one.
    An automaton over the vocabulary lists the suffixes of every prefix, longest first, in one pass."""

    def __init__(self, table: WordTable):
        super().__init__()
        vocab = table.tok.get_vocab(with_added_tokens=False)
        texts = [""] * (max(vocab.values()) + 1)
        self.ends = ahocorasick.Automaton()
        for text, i in vocab.items():
            texts[i] = text
            self.ends.add_word(text, (len(text), i))
        self.ends.make_automaton()
        self.fits, self.code = Neighbours(table.tok, texts), dict(enumerate(_LETTER))

    def shrink(self) -> None:
        """Empty what has grown past its bound."""
        for table in (self, self.fits):
            if len(table) > 2 * TABLE_WORDS:  # entries are a few bytes
                table.clear()

    def __missing__(self, word: str) -> bytes | list[int]:
        w = word[1:] if word[0] == "\0" else word.encode().decode("latin-1").translate(self.code)
        last, counts, fits = [0], [0], self.fits
        for end, (n, token) in self.ends.iter(w):
            if end + 1 == len(last):
                start = end + 1 - n
                if not start or fits[last[start] << ID_BITS | token]:
                    last.append(token)
                    counts.append(counts[start] + 1)
        if len(last) <= len(w):
            raise ValueError(f"no encoding of {w[: len(last)]!r}")
        got = self[word] = bytes(counts[1:]) if counts[-1] < 256 else counts[1:]
        return got


def tokens_upto(stored: bytes, n_bytes: int) -> int:
    """Tokens of the first n_bytes bytes, from a stored prefix table; inside a character, as its word's bytes add up."""
    v = int(np.frombuffer(stored, "<i4")[n_bytes])
    return v if v >= 0 else ~v


def longest_prefix(stored: bytes, budget: int) -> int:
    """Bytes of the longest prefix of whole characters that takes at most ``budget`` tokens, from a stored prefix table."""
    v = np.frombuffer(stored, "<i4")
    fits = np.flatnonzero((v >= 0) & (v <= budget))
    return int(fits[-1]) if len(fits) else 0


class PrefixCounter:
    """Exact token counts at every prefix of a text.

    Inside a split word a prefix's count is that of the words before and the word's own prefix, as the same words split
    off, but for three cases that get counts of their own: a whitespace run is one word up to its last character, and
    only what follows splits that off; 're, 've and 'll aren't contractions before their last letter; and a special
    token cut short is plain text that may go on with the word before it."""

    def __init__(self, path: str):
        self.words = WordTable(path)
        if self.words.lower:
            raise ValueError("prefixes are counted for tokenizers that don't normalise texts")
        self.counts = PrefixTable(self.words)

    def _plain(self, word: str) -> str:
        """The text of a split word."""
        return bytes(_BYTE[c] for c in word[1:]).decode() if word[0] == "\0" else word

    def _total(self, text: str) -> int:
        return sum(self.counts[w][-1] for w in self.words.words(text))

    def table(self, text: str | None, prefixes: bool = False) -> tuple[np.ndarray, np.ndarray, bytes | None]:
        """(end byte of each split word, token count of the text up to there, prefix table if asked for).

        The prefix table holds 4 bytes for each byte prefix, the empty one first: its count, or ~count where it ends
        inside a character."""
        self.counts.shrink()
        text = text or ""
        ends, totals, inside, own = [], [], [], []
        fixed: list[tuple[int, int]] = []  # (byte, count) of prefixes that split otherwise
        at = count = 0
        last = ""  # the split word before, if no special token is between
        for special, part in self.words.parts(text):
            if special:
                n = len(part.encode())
                if prefixes:
                    before = count - (own[-1] if last else 0)
                    fixed += [(at + len(part[:m].encode()), before + self._total(last + part[:m])) for m in range(1, len(part))]
                    inside.append(np.ones(n, np.int32))
                ends.append(n)
                totals.append(1)
                own.append(1)
                at, count, last = at + n, count + 1, ""
                continue
            words = self.words.words(part)
            got = list(map(self.counts.__getitem__, words))
            n, t = list(map(len, got)), list(map(_LAST, got))
            if prefixes:
                inside += [np.frombuffer(b"".join(got), np.uint8)] if all(type(g) is bytes for g in got) else [np.array(list(g), np.int32) for g in got]
                fixed += self._fixed(words, n, t, at, count)
                last = self._plain(words[-1]) if words else last
            ends += n
            totals += t
            own += t
            at, count = at + sum(n), count + sum(t)
        lengths, sums = np.array(ends, np.int64), np.cumsum(totals, dtype=np.int64)
        if not prefixes:
            return np.cumsum(lengths), sums, None
        out = np.zeros(at + 1, np.int32)
        if at:
            out[1:] = np.concatenate(inside) + np.repeat(sums - np.array(own), lengths)
        for k, v in fixed:
            out[k] = v
        if not text.isascii():
            later = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) & 0xC0 == 0x80)
            out[later] = ~out[later]
        return np.cumsum(lengths), sums, out.astype("<i4").tobytes()

    def _fixed(self, words: list[str], n: list[int], t: list[int], at: int, count: int) -> list[tuple[int, int]]:
        """(byte, count) of prefixes that end with a whitespace run of two words, or inside a contraction."""
        found = [i for i, w in enumerate(words) if w[0] in _ODD_FIRST and (w[0] != " " or len(w) == 1 or w[1] in _ODD_FIRST)]
        if not found:
            return []
        ends, totals, out = list(accumulate(n, initial=at)), list(accumulate(t, initial=count)), []
        for i in found:
            w = self._plain(words[i])
            if w in _LONG_CONTRACTIONS:
                out.append((ends[i] + 2, totals[i] + self._total("'") + self._total(w[1])))
            elif i + 1 < len(words) and _ALL_SPACE.fullmatch(w) and _ALL_SPACE.match(after := self._plain(words[i + 1])):
                out.append((ends[i + 1] + len(after[0].encode()), totals[i] + self._total(w + after[0])))
        return out

    def prefix_table(self, text: str) -> bytes:
        return self.table(text, prefixes=True)[2]

    def upto(self, text: str, n_bytes: int) -> int:
        return tokens_upto(self.prefix_table(text), n_bytes)

    def longest(self, text: str, budget: int) -> int:
        return longest_prefix(self.prefix_table(text), budget)


def _counters(path: str, cache: dict = {}) -> PrefixCounter:  # noqa: B006
    if path not in cache:
        cache[path] = PrefixCounter(path)
    return cache[path]


def prefix_token_counts(documents: DataFrame, path: str, keep_table: bool = True, budget: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, if keep_table, ends array<long>, counts array<long> (each split word's end and the
    whole text's count there) and prefixes binary: the token count of every prefix, as tokens_upto and longest_prefix
    read it; with a budget of tokens also fits_bytes, the longest prefix it has room for, read from that table in the worker.
    For byte-level tokenizers; one that normalises texts is an error, as a prefix of its words needn't be one of the text.

    A null or empty text has 0 bytes, 0 tokens and empty arrays. Repeated rows stay, other columns are ignored."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counters(path)
        for pdf in batches:
            # prefix tables are four times their texts: they leave the worker in parts
            part = np.cumsum([len(t or "") for t in pdf["text"]]) // TABLE_CHARS
            for _, own in pdf.groupby(part, sort=False):
                got = [counter.table(t, keep_table or budget is not None) for t in own["text"]]
                out = {"doc_id": own["doc_id"].array, "n_bytes": [int(e[-1]) if len(e) else 0 for e, _, _ in got], "n_tokens": [int(c[-1]) if len(c) else 0 for _, c, _ in got]}
                if budget is not None:
                    out["fits_bytes"] = [longest_prefix(p, budget) for _, _, p in got]
                if keep_table:
                    out |= {"ends": [e for e, _, _ in got], "counts": [c for _, c, _ in got], "prefixes": [p for _, _, p in got]}
                yield pd.DataFrame(out)

    schema = "doc_id long, n_bytes long, n_tokens long" + ", fits_bytes long" * (budget is not None) + ", ends array<long>, counts array<long>, prefixes binary" * keep_table
    return map_documents(with_columns(documents, doc_id="long", text="string"), run, schema)


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
