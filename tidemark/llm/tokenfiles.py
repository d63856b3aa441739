"""Token-id files with Re-Pair grammar compression.

Documents are dealt by ranges of doc_id, encoded, and cut into shards of SHARD_TOKENS ids or somewhat more. In each shard frequent
id pairs are replaced by new ids ("nonterminals") in rounds until no pair stands LEAST times; every round takes the commonest
pairs at once, and never a pair that crosses a document's end. Pairs inside words come first: they are counted and replaced
once for each distinct word. A shard's row holds the rules, the length each rule expands to, the compressed stream and
where each document starts in it, so a single document decodes without the others (`decode_document`), and its length is
known without decoding.

Shards are rows of a Parquet table in the shared folder; Spark's committer makes the write safe against lost executors.

Null and empty texts are the end id alone. Rows with the same doc_id stand in the order of their texts; null doc_ids come
first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, SPACE, distinct, ranges, slices, text_parts, word_spans
from .common import new_path, partitions, trimmed, tune
from .wordbook import Book, as_list, ids_of_spans

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SHARD_TOKENS = 1_000_000
END = 1
#: Pairs that a round replaces at once, and how often a pair must stand in the shard to be replaced at all.
PAIRS_A_ROUND = 6000
LEAST = 8
#: Words of letters that the tokenizer gets in one line.
LINE = 32
#: Bytes of text that a worker looks at together.
SLICE = 4 << 20


def _frequent_pairs(key: np.ndarray, own: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which of the places may have a pair that stands LEAST times or more, places of the commonest such pairs, which pair each
    is, these pairs by falling count). key: the pairs at the places, own: how often each place stands, bits: what an id takes.
    Counts are exact: sums by slots of a hash are bounds from above, and what passes them is counted by sorting."""
    slots = min(20, max(8, int(4 * len(key)).bit_length()))
    slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - slots)).astype(np.int64)
    most = np.bincount(slot, weights=own, minlength=1 << slots)
    full = most[most >= LEAST]
    least = LEAST if len(full) <= PAIRS_A_ROUND else int(np.partition(full, -PAIRS_A_ROUND)[-PAIRS_A_ROUND])
    most = most[slot]
    stay = most >= LEAST
    at = np.flatnonzero(most >= least)
    key, own = key[at], own if own is None else own[at]
    first, which = distinct((key >> 32 << bits) | (key & 0xFFFFFFFF), 2 * bits)
    counts = np.bincount(which, weights=own, minlength=len(first))
    good = np.flatnonzero(counts >= LEAST)
    good = good[np.argsort(-counts[good], kind="stable")]
    rank = np.full(len(first), -1)
    rank[good] = np.arange(len(good))
    index = rank[which]
    stay[at[index < 0]] = False
    return stay, at[index >= 0], index[index >= 0], key[first[good]]


class Grammar:
    """Rules so far: rule k replaces its pair by the id vocabulary + k and expands to lengths[k] ids."""

    def __init__(self, vocabulary: int):
        self.vocabulary = vocabulary
        self.rules, self.lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

    def sizes(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), np.int64)
        deep = x >= self.vocabulary
        out[deep] = self.lengths[x[deep] - self.vocabulary]
        return out

    def shrink(self, s: np.ndarray, last: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The stream after rounds of replacing until no pair stands LEAST times; never a pair across `last`. weight: how often
        each place of the stream stands in the shard. Places that are replaced stay and are skipped by links to the next and the
        one before, so that a round costs what its open places cost and not the whole stream."""
        s, last = s.copy(), last.copy()
        after, before = np.arange(1, len(s) + 1), np.maximum(np.arange(-1, len(s)), 0)
        gone, taken = np.zeros(len(s), bool), np.zeros(len(s) + 1, bool)
        live = np.append(~last[:-1], False) if len(s) else last  # places whose pairs may stand so often
        while len(at := np.flatnonzero(live)):
            bits = (self.vocabulary + len(self.rules)).bit_length()
            stay, some, index, pairs = _frequent_pairs((s[at] << 32) | s[after[at]], weight if weight is None else weight[at], bits)
            live[at[~stay]] = False
            if not len(some):
                continue  # slots that seemed full held several pairs, none of them frequent; these are no longer live
            at, won = at[some], []
            for commoner in (True, False):  # where places overlap the commoner pair wins, then every second place from the left
                open_ = ~(taken[at] | taken[after[at]])
                at, index = at[open_], index[open_]
                near = after[at[:-1]] == at[1:]
                win = np.ones(len(at), bool)
                if commoner:
                    win[1:] &= ~near | (index[1:] < index[:-1])
                    win[:-1] &= ~near | (index[:-1] < index[1:])
                else:
                    first = np.flatnonzero(np.append(True, ~near))[: len(at)]
                    win = (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0
                won.append((at[win], index[win]))
                taken[at[win]] = taken[after[at[win]]] = True
            places, index = (np.concatenate(x) for x in zip(*won, strict=True))
            second = after[places]
            taken[places] = taken[second] = False
            used = np.bincount(index, minlength=len(pairs)) > 0
            rule = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], axis=1)
            s[places] = self.vocabulary + len(self.rules) + (np.cumsum(used) - 1)[index]
            last[places] = last[second]
            self.lengths = np.concatenate([self.lengths, self.sizes(rule[:, 0]) + self.sizes(rule[:, 1])])
            self.rules = np.concatenate([self.rules, rule])
            after[places] = after[second]
            before[after[second]] = places
            gone[second], live[second] = True, False
            changed = np.concatenate([places, before[places]])
            live[changed] = ~last[changed]
        keep = ~gone
        return s[keep], last[keep], weight if weight is None else weight[keep]


def expansions(rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rules one after another, where each rule's begin): rules whose parts are done, again and again."""
    at = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.int64)
    done = np.zeros(len(rules), bool)
    todo = np.arange(len(rules))
    while len(todo):
        ready = np.ones(len(todo), bool)
        for side in (0, 1):
            x = rules[todo, side]
            ready &= (x < vocabulary) | done[np.maximum(x - vocabulary, 0)]
        now, first = todo[ready], at[todo[ready]].copy()
        for side in (0, 1):
            x = rules[now, side]
            plain = x < vocabulary
            flat[first[plain]] = x[plain]
            deep = np.maximum(x - vocabulary, 0)
            n = np.where(plain, 1, lengths[deep])
            many = np.where(plain, 0, n)
            flat[ranges(first, many)] = flat[ranges(at[deep], many)]
            first += n
        done[now] = True
        todo = todo[~ready]
    return flat, at


def expand(stream: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    flat, at = expansions(rules, lengths, vocabulary)
    table = np.concatenate([flat, np.arange(vocabulary)])  # plain ids stand for themselves
    at, n = np.append(at, 0), np.append(lengths, 1)
    rule = np.where(stream >= vocabulary, stream - vocabulary, len(lengths))
    return table[ranges(np.where(stream >= vocabulary, at[rule], len(flat) + stream), n[rule])]


def _pack(x: np.ndarray) -> bytes:
    """A byte for the width, then the numbers."""
    width = "<u2" if not len(x) or int(x.max()) < 1 << 16 else "<u4"
    return width[-1].encode() + x.astype(width).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[:1].decode()}", offset=1).astype(np.int64)


def write_shard(ids: np.ndarray, at: np.ndarray, n: np.ndarray, which: np.ndarray, words: np.ndarray, vocabulary: int, end: int = END) -> dict[str, bytes | int]:
    """ids, at, n: the distinct words' ids one after another, where each word's begin and how many it has; which: the word at every
    place; words: how many places each document has. Pairs inside words are replaced first, once for each distinct word with
    the count of its places; then pairs in the documents' streams. The end id follows each document."""
    grammar = Grammar(vocabulary)
    count = np.bincount(which, minlength=len(n))
    some = np.flatnonzero((n > 0) & (count > 0))
    source = ids[ranges(at[some], n[some])].astype(np.int64)
    close = np.zeros(len(source), bool)
    close[np.cumsum(n[some]) - 1] = True
    word, close, _ = grammar.shrink(source, close, np.repeat(count[some], n[some]).astype(np.float64))
    short = np.zeros(len(n), np.int64)
    short[some] = np.diff(np.flatnonzero(np.append(True, close)))
    own = short[which]
    size = np.add.reduceat(np.append(own, 0), np.minimum(np.cumsum(words) - words, len(own))) if len(words) else words
    size = np.where(words > 0, size, 0) + 1
    stream = np.full(int(size.sum()), end, np.int64)
    last = np.zeros(len(stream), bool)
    last[np.cumsum(size) - 1] = True
    stream[~last] = word[ranges((np.cumsum(short) - short)[which], own)]
    stream, last, _ = grammar.shrink(stream, last)
    starts = np.flatnonzero(np.append(True, last[:-1]))
    return {"vocabulary": vocabulary, "n_tokens": int(grammar.sizes(stream).sum()), "rules": _pack(grammar.rules.ravel()), "lengths": _pack(grammar.lengths), "stream": _pack(stream), "starts": _pack(starts)}


def document_lengths(shard: dict) -> np.ndarray:
    """Ids of each document, from the rules' lengths alone."""
    s, lengths, v = _unpack(shard["stream"]), _unpack(shard["lengths"]), shard["vocabulary"]
    size = np.ones(len(s), np.int64)
    size[s >= v] = lengths[s[s >= v] - v]
    return np.add.reduceat(size, _unpack(shard["starts"])) if len(s) else np.zeros(0, np.int64)


def decode_document(shard: dict, k: int) -> np.ndarray:
    """Ids of the shard's k-th document, without decoding the others."""
    starts, s = _unpack(shard["starts"]), _unpack(shard["stream"])
    return expand(s[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(s)], _unpack(shard["rules"]).reshape(-1, 2), _unpack(shard["lengths"]), shard["vocabulary"])


#: What may end a word and be taken apart from it: marks without the apostrophe and what names of special tokens begin with.
MARKS = "!#$%&()*+,-./:;=>?@[]^_{}~"
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(MARKS.encode(), np.uint8)] = True


class WordCoder:
    """Ids of texts. Where the tokenizer drops white space and looks at nothing across it, texts go word by word through a
    dictionary; where it also lowers case and parts letters from full stops and commas, words share their stems' ids. Both are
    tried out on the tokenizer's own vocabulary when the coder is made; a tokenizer without them gets whole texts or whole words."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.words, self.stems = Book(), Book(24 << 20)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        plain = sorted(w.removesuffix("</w>") for w in vocab if w.removesuffix("</w>").isascii() and w.removesuffix("</w>").isalpha())
        probe = [*plain[:: max(1, len(plain) // 500)], "It's", "ab12", "a-b", "#x", "<b>", "q!?", "\u00e9t\u00e9", "\u6f22\u5b57", "e\u0301", "\u0301x"]
        alone = self.ids(probe)
        joined = [y for x in alone for y in x]
        self.by_word = all(self.ids([f"{a}{gap.join(probe)}{a}"])[0] == joined for gap, a in ((" ", ""), ("\n", " "), (" \t\r\n  ", "\x0b"), ("\x0c", "")))
        letters = [k for k, w in enumerate(probe) if w.isascii() and w.isalpha()]
        self.lowers = self.by_word and self.ids([probe[k].upper() for k in letters]) == self.ids([probe[k].lower() for k in letters]) and self.ids([w.upper() for w in probe if w.isascii()]) == self.ids([w.lower() for w in probe if w.isascii()])
        tails = [*MARKS, *(a + b for a, b in zip(MARKS, MARKS[1:] + MARKS[:1], strict=True)), ".,.,", "...", "###", MARKS]
        self.parts = self.lowers and all(self.ids([probe[k] + m for k in letters]) == [alone[k] + x for k in letters] for m, x in zip(tails, self.ids(tails), strict=True))
        marks = [w for w in plain if len(w) == 8 and w.islower()]
        coded = self.ids(marks) if self.by_word else []
        one = next((k for k, x in enumerate(coded) if len(x) == 1), None)
        self.gaps: list[tuple[str, int, int]] = []  # what parts the words of a line, its id, and the words of a line
        if one is not None:
            self.gaps.append((f" {marks[one]} ", coded[one][0], 200))
        zero = self.ids(["0"])[0]
        words = [probe[k] for k in letters] + ["\u00e9t\u00e9", "\u6f22\u5b57"]
        if self.by_word and len(zero) == 1 and self._joined(words, ("0", zero[0], len(words))) == self.ids(words):
            self.gaps.append(("0", zero[0], LINE))  # only between words of letters: the tokenizer takes digits apart
        words = [w for w in words if w.isascii() and w.islower()]
        self.bare = [self._bare(words, latin) for latin in (False, True)] if self.by_word else [None, None]

    def _bare(self, words: list[str], latin: bool) -> Tokenizer | None:
        """The library's tokenizer with the same model and nothing before it but a cut at digits (latin: and the step to bytes), if
        words of a-z (latin: and of the lower letters of Latin-1) have the same ids by it. latin: where the tokenizer lowers
        case, the upper letters must have the ids of the lower ones, too."""
        from tokenizers import Tokenizer, pre_tokenizers

        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(x.content.isalpha() for x in added):
            return None
        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.Digits(individual_digits=True)
        letters = [chr(k) for k in range(0x61, 0x7B)]
        if latin:
            bare.pre_tokenizer = pre_tokenizers.Sequence([bare.pre_tokenizer, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            letters = [chr(k) for k in range(0xDF, 0x100) if k != 0xF7]
            words = [w[: k % 4] + x + w[k % 4 :] for k, w in enumerate(words) for x in (letters[k % len(letters)], letters[-k % len(letters)])]
        words = [*words, *letters, *(a + b for a in letters for b in letters), *(a + b for a, b in zip(words, words[1:], strict=False)), "".join(words)]
        want = self.ids(words)
        if latin and self.lowers and self.ids([w.upper() for w in words if not {"\u00df", "\u00ff"} & {*w}]) != [x for w, x in zip(words, want, strict=True) if not {"\u00df", "\u00ff"} & {*w}]:
            return None
        mark = bare.encode("0", add_special_tokens=False).ids
        whole = bare.encode("0".join(words), add_special_tokens=False).ids
        return bare if len(mark) == 1 and whole == [y for x in want for y in (*x, *mark)][:-1] else None

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str], gap: tuple[str, int, int]) -> list[list[int]]:
        """Ids of words that go in lines, with a gap of one id between them; a line whose ids hold that id elsewhere goes word by word."""
        between, mark, n = gap
        lines = [words[i : i + n] for i in range(0, len(words), n)]
        out = []
        for line, ids in zip(lines, self.ids([between.join(x) for x in lines]), strict=True):
            if ids.count(mark) != len(line) - 1:
                out += self.ids(line)
                continue
            at = [-1, *(k for k, x in enumerate(ids) if x == mark), len(ids)]
            out += [ids[i + 1 : j] for i, j in zip(at, at[1:], strict=False)]
        return out

    def learn_stems(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words; those of plain letters go to the bare tokenizers in lines, a digit after each, the others by _others."""
        low, end = LOWER[raw] if self.lowers else raw, np.cumsum(size)
        lead = np.append(False, raw[:-1] == 0xC3)
        lead[(end - size)[size > 0]] = False
        if self.lowers:
            low = np.where(lead & (raw >= 0x80) & (raw < 0x9F) & (raw != 0x97), raw + 0x20, low)
        ascii_ = (low >= 0x61) & (low <= 0x7A)
        latin = ascii_ | (raw == 0xC3) | (lead & (low >= 0x9F) & (low != 0xB7))
        kind = np.full(len(size), 2)  # 0: a-z, 1: lower letters of Latin-1, 2: others
        for k, inside in ((1, latin), (0, ascii_)):
            count = np.append(0, np.cumsum(inside))
            kind[(count[end] - count[end - size] == size) & (self.bare[k] is not None)] = k
        n, first, parts = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
        for k in range(3):
            at = np.flatnonzero(kind == k)
            if not len(at):
                continue
            mine = np.repeat(kind == k, size)
            ids, n[at] = self._others(raw[mine], size[at]) if k == 2 else self._lines(self.bare[k], low[mine], raw[mine], size[at])
            first[at] = sum(map(len, parts)) + np.cumsum(n[at]) - n[at]
            parts.append(ids)
        return np.concatenate([np.zeros(0, np.uint32), *parts])[ranges(first, n)], n

    def _lines(self, bare: Tokenizer, low: np.ndarray, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters; if a digit's id doesn't stand once for each word of a line, all go by _others."""
        after = np.cumsum(size + 1)
        text = np.full(len(low) + len(size), 0x30, np.uint8)
        inside = np.ones(len(text), bool)
        inside[after - 1] = False
        text[inside] = low
        cuts, whole = [*np.append(0, after)[: len(size) : LINE].tolist(), len(text)], text.tobytes()
        lines = bare.encode_batch_fast([whole[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)
        parts = [np.array(e.ids, np.uint32) for e in lines]
        ids = np.concatenate(parts)
        at = np.flatnonzero(ids == ids[-1])
        last = np.minimum(np.arange(1, len(parts) + 1) * LINE, len(size)) - 1
        if len(at) != len(size) or not np.array_equal(at[last], np.cumsum([len(x) for x in parts]) - 1):
            return self._others(raw, size)
        return ids[ids != ids[-1]], np.diff(at, prepend=-1) - 1

    def _others(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [w.decode() for w in as_list(raw, size)]
        plain = [len(self.gaps) > 1 and w.isalpha() for w in words]
        out: list[list[int]] = [[]] * len(words)
        for kind in (True, False):
            at = [k for k, x in enumerate(plain) if x == kind]
            some = [words[k] for k in at]
            for k, x in zip(at, self._joined(some, self.gaps[-1 if kind else 0]) if self.gaps else self.ids(some), strict=True):
                out[k] = x
        return np.array([y for x in out for y in x], np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def learn_words(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.lowers:
            return self.learn_stems(raw, size)
        end = np.cumsum(size)
        start = end - size
        plain = np.add.reduceat((raw >= 0x80).astype(np.int64), start) == 0  # beyond ASCII a word stays as it is
        low = np.where(np.repeat(plain, size), LOWER[raw], raw)
        odd = np.append((low[:-1] == 0x3C) & (low[1:] == 0x7C), False)  # the names of special tokens have case
        plain &= np.add.reduceat(odd.astype(np.int64), start) == 0
        low = np.where(np.repeat(plain, size), low, raw)
        cut = end.copy()
        todo = np.flatnonzero(plain | (raw[end - 1] < 0x80)) if self.parts else np.zeros(0, np.int64)
        todo = todo[np.add.reduceat(odd.astype(np.int64), start)[todo] == 0]
        while len(todo):
            todo = todo[(cut[todo] > start[todo]) & _MARK[low[np.maximum(cut[todo] - 1, 0)]]]
            cut[todo] -= 1
        before = low[np.maximum(cut - 1, 0)]
        letter = (before >= 0x61) & (before <= 0x7A)
        for k in np.flatnonzero((before >= 0x80) & (cut < end) & (cut > start)).tolist():
            letter[k] = low[start[k] : cut[k]].tobytes().decode()[-1].isalpha()
        cut = np.where((cut > start) & letter, cut, end)
        a, z = np.stack([start, cut], axis=1).ravel(), np.stack([cut, end], axis=1).ravel()
        some = np.flatnonzero(z > a)  # most words have no marks
        ids, at, n, which = ids_of_spans(self.stems, low, a[some], z[some], self.learn_stems)
        each = np.zeros(len(a), np.int64)
        each[some] = n[which]
        return ids[ranges(at[which], n[which])], each.reshape(-1, 2).sum(axis=1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct words, where each word's begin, how many it has, the word at every place, places of each text).
        A tokenizer that can't go by words has each text as one word."""
        data, offs = text_parts(column)
        if self.by_word:
            start, end, word_offs = word_spans(data, offs, ~SPACE)
            if not len(start):
                none = np.zeros(0, np.int64)
                return none.astype(np.uint32), none, none, none, np.diff(word_offs)
            return *ids_of_spans(self.words, data, start, end, self.learn_words), np.diff(word_offs)
        each = self.ids([t or "" for t in column.to_pylist()])
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.array([y for x in each for y in x], np.uint32), np.cumsum(n) - n, n, np.arange(len(each)), np.ones(len(each), np.int64)


_CODERS: dict[int, WordCoder] = {}


def _schema(docs: DataFrame) -> T.StructType:
    ids = T.ArrayType(docs.schema["doc_id"].dataType)
    out = T.StructType().add("part", "integer").add("shard", "integer").add("doc_ids", ids).add("vocabulary", "integer").add("n_tokens", "long")
    for name in ("rules", "lengths", "stream", "starts"):
        out = out.add(name, "binary")
    return out


def write_tokens(docs: DataFrame, tokenizer_path: str, end: int = END, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode all texts and write the shards; the folder of the files."""
    spark = tune(docs.sparkSession)
    path = path or new_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a fixed vocabulary file
    schema = _schema(docs)
    laid = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        key = hash(sent.value)
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = WordCoder(sent.value)
        code = _CODERS[key]
        vocabulary = code.tokenizer.get_vocab_size(with_added_tokens=True)
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids, at, n, which, words = zip(*held, strict=True)
            ids_before = np.cumsum([0, *map(len, ids)])
            words_before = np.cumsum([0, *map(len, n)])
            row = write_shard(
                np.concatenate(ids), np.concatenate([x + k for x, k in zip(at, ids_before, strict=False)]), np.concatenate(n),
                np.concatenate([x + k for x, k in zip(which, words_before, strict=False)]), np.concatenate(words), vocabulary, end,
            )
            row |= {"part": part, "shard": shard, "doc_ids": names}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], _arrow(f.dataType)) for f in schema.fields], names=schema.names)

        for batch in trimmed(batches):
            for b in slices(batch, most=min(SLICE, 4 * shard_tokens)):
                coded = code(b.column("text"))
                names += b.column("doc_id").to_pylist()
                held.append(coded)
                size += int(coded[2][coded[3]].sum()) + b.num_rows
                if size >= shard_tokens:
                    yield flush()
                    names, held, size, shard = [], [], 0, shard + 1
        if names:
            yield flush()

    laid.mapInArrow(run, schema).write.parquet(path)
    return path


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_tokens(docs_schema: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32) from the files alone."""
    spark = tune(docs_schema.sparkSession)
    shards = spark.read.schema(_schema(docs_schema)).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each partition
    first, before = [], 0
    for part, n in totals:
        first.append((part, before))
        before += n
    firsts = spark.createDataFrame(first, "part int, _first long")
    order = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "shard", "n_tokens").withColumn("_within", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(F.broadcast(firsts), "part")
    placed = shards.join(places.select("part", "shard", (F.col("_first") + F.col("_within")).alias("first")), ["part", "shard"])
    kind = docs_schema.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind).add("start", "long").add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sizes = document_lengths(row)
                raw = expand(_unpack(row["stream"]), _unpack(row["rules"]).reshape(-1, 2), _unpack(row["lengths"]), row["vocabulary"]).astype("<u4")
                ends = np.cumsum(sizes)
                ids = [raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], _arrow(kind)), pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())], names=schema.names)

    return placed.mapInArrow(run, schema)

