"""Token ids and token counts of whole texts (operators 1 and 5).

``WordEncoder`` gives exactly the ids of the ``tokenizers`` library for a
vocabulary file whose pre-tokenizer never joins text across white space: such a
text is encoded chunk by chunk (a chunk is a run without ASCII white space), and
each distinct chunk is encoded once and then looked up.  Chunks in a plain
alphabet are cut and merged here, many at once; every other chunk goes through
the library unchanged.

``spliced_ids`` is overlap resynchronisation: a huge document is encoded in
overlapping chunks with offsets, and neighbouring chunks are joined at a boundary
that both encodings prove stable; where none is found the overlap is widened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The normalizer and pre-tokenizer for which chunks are independent.
CHUNK_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CHUNK_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Latin letters that are composed already and whose lower case is one character.
LATIN = "À-ÖØ-öø-ÿ"
#: No ``<``: chunks that may hold a special token go through the library.
PLAIN = re.compile(rf"[!-;=-~{LATIN}]+")
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z{LATIN}0-9]+")
#: A chunk that is one word of letters or one mark.
ONE_WORD = rf"^(?:[a-zß-öø-ÿ]+|[.,])$"
#: Bytes of letters, blanks, full stops and commas in lower-cased text.
EVEN = bytes([*range(97, 123), 10, 32, 44, 46, 0xC3, *range(0x80, 0xC0)])
LONGEST = 40


def uneven(low: str) -> bool:
    """Whether lower-cased text has anything but letters and single marks."""
    return bool(low.encode().translate(None, EVEN)) or any(x in low for x in ("..", ",,", ".,", ",.", "×", "÷", "\x80"))


class WordBpe:
    """Byte-pair merges of many words at once, by arrays.

    Every word starts as its bytes, the last one with the end-of-word suffix; in
    each turn every word that still can merges its pair of lowest rank, leftmost
    first, as the library's model does.
    """

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        self.size = len(vocab)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[x] * self.size + vocab[y] for x, y in pairs], np.int64)
        to = np.array([vocab[x + y] for x, y in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.by_rank = key[order], order.astype(np.int32), to.astype(np.int32)
        self.none = np.int32(2**31 - 1)

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pair = x.astype(np.int64) * self.size + y
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], self.none)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and of each word (a large_string) the place and number of its ids."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        sizes = np.diff(ends)
        at, count, flat, base = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for n in np.unique(sizes).tolist():
            place = np.flatnonzero(sizes == n)
            ids, held = self._merge(data[ends[place][:, None] + np.arange(n)])
            stop = np.cumsum(held)
            at[place], count[place] = base + stop - held, held
            base += int(stop[-1])
            flat.append(ids[np.arange(n) < held[:, None]].astype(np.uint32))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), at, count

    def _merge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, row by row, and how many of each row hold."""
        m, n = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        held = np.full(m, n, np.int64)
        live, cur = np.arange(m), ids.copy()
        rank = self._ranks(cur[:, :-1].ravel(), cur[:, 1:].ravel()).reshape(m, n - 1)
        while cur.shape[1] > 1:
            wide = cur.shape[1]
            j = rank.argmin(1)
            low = rank[np.arange(len(rank)), j]
            go = low != self.none
            if not go.all():
                stop = live[~go]
                ids[stop, :wide] = cur[~go]
                held[stop] = wide
                live, cur, rank, j, low = live[go], cur[go], rank[go], j[go], low[go]
                if not len(live):
                    return ids, held
            row, j_ = np.arange(len(live)), j[:, None]
            cur = np.where(np.arange(wide - 1) <= j_, cur[:, :-1], cur[:, 1:])
            cur[row, j] = self.by_rank[low]
            rank = np.where(np.arange(wide - 2) < j_, rank[:, :-1], rank[:, 1:])
            a = np.flatnonzero(j > 0)
            rank[a, j[a] - 1] = self._ranks(cur[a, j[a] - 1], cur[a, j[a]])
            a = np.flatnonzero(j < wide - 2)
            rank[a, j[a]] = self._ranks(cur[a, j[a]], cur[a, j[a] + 1])
        ids[live, :1] = cur
        held[live] = 1
        return ids, held


class WordEncoder:
    """Ids of chunks, memoized; the memo is emptied when it holds ``limit`` chunks."""

    def __init__(self, path: str, limit: int = 600_000) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.library.no_truncation()
        self.library.no_padding()
        model, parts = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = bool(
            spec.get("normalizer") == CHUNK_NORMALIZER and parts[0].get("pattern") == {"Regex": CHUNK_SPLIT}
            and model.get("end_of_word_suffix") and not (model.get("dropout") or model.get("ignore_merges"))
            and all("<" in t["content"] and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        )
        self.limit = limit
        if self.by_chunk:
            self.bpe = WordBpe(model)
            self._clear()

    def _clear(self) -> None:
        self.memo = pa.array([""], pa.large_string())
        self.at, self.n = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _add(self, chunks: pa.Array, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        self.memo = pa.concat_arrays([self.memo, chunks])
        self.at = np.concatenate([self.at, len(self.flat) + at])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, flat])

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Encode chunks that the memo lacks; their places in it."""
        one = pc.and_(pc.match_substring_regex(chunks, ONE_WORD), pc.less_equal(pc.binary_length(chunks), LONGEST))
        places = np.zeros(len(chunks), np.int64)
        mask = one.to_numpy(zero_copy_only=False)
        plain = chunks.filter(one)
        places[mask] = len(self.memo) + np.arange(len(plain))
        self._add(plain, *self.bpe.encode(plain))
        rest = chunks.filter(pc.invert(one))
        if not len(rest):
            return places
        cuts: list[str] = []  # words of the chunks in a plain alphabet, one after the other
        counts, odd = [], []
        for c in rest.to_pylist():
            parts = PRETOKEN.findall(c.lower()) if PLAIN.fullmatch(c) else None
            if parts and max(map(len, parts)) <= LONGEST // 2:
                cuts += parts
                counts.append(len(parts))
            else:
                odd.append(np.array(self.library.encode(c, add_special_tokens=False).ids, np.uint32))
                counts.append(-1)
        words = pa.array(cuts, pa.large_string()).dictionary_encode()
        flat, at, n = self.bpe.encode(words.dictionary)
        which = words.indices.to_numpy()
        size = n[which]
        stop = np.cumsum(size)
        ids = flat[np.repeat(at[which] - stop + size, size) + np.arange(int(size.sum()))]
        k = np.array(counts)
        edge = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(np.maximum(k, 0))]).astype(np.int64)]
        own, length = edge[:-1].copy(), np.diff(edge)
        lone = np.array([len(x) for x in odd], np.int64)
        own[k < 0], length[k < 0] = len(ids) + np.cumsum(lone) - lone, lone
        places[~mask] = len(self.memo) + np.arange(len(rest))
        self._add(rest, np.concatenate([ids, *odd]).astype(np.uint32), own, length)
        return places

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Memo places of all chunks of the texts, and how many each text has."""
        if len(self.memo) > self.limit:
            self._clear()
        ready = []
        for t in texts:
            low = t.lower()
            if len(low) == len(t) and not uneven(low):  # marks at a word's end are words
                t = low.replace("\n", " ").replace(", ", " , ").replace(". ", " . ")
            else:
                for c in "\n\t\r\v\f":
                    if c in t:
                        t = t.replace(c, " ")
            ready.append(t)
        parts = pc.split_pattern(pa.array(ready, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.memo)
        codes = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            codes[codes < 0] = self._learn(coded.dictionary.filter(found.is_null()))
        return codes[coded.indices.to_numpy()], parts.value_lengths().to_numpy().astype(np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        if not self.by_chunk:
            return np.array([len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)], np.int64)
        if not texts:
            return np.zeros(0, np.int64)
        codes, n = self._codes(texts)
        return np.add.reduceat(self.n[codes], np.cumsum(n) - n)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids (uint32) of each text."""
        if not self.by_chunk:
            for e in self.library.encode_batch(texts, add_special_tokens=False):
                yield np.array(e.ids, np.uint32)
            return
        codes, n = self._codes(texts)
        stop = np.cumsum(n)
        for a, b in zip(stop - n, stop):
            c = codes[a:b]
            size = self.n[c]
            to = np.cumsum(size)
            total = int(to[-1])
            yield self.flat[np.repeat(self.at[c] - to + size, size) + np.arange(total)]


def batches(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


Encoded = tuple[list[int], list[tuple[int, int]]]


def library_offsets(path: str) -> Callable[[str], Encoded]:
    """A function giving ids and character offsets, for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def piece_offsets(text: str) -> Encoded:
            out = model.encode(text, return_type="proto")
            ids, spans = [p.id for p in out.pieces], [(p.begin, p.end) for p in out.pieces]
            if not text.isascii():  # the library counts bytes
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]).tolist()
                spans = [(at[b], at[e]) for b, e in spans]
            return ids, spans

        return piece_offsets
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def offsets(text: str) -> Encoded:
        e = own.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    return offsets


#: A cut is proven only where a word begins or ends.
CUT_SPACE = " \n\t\r\f\v"


def stable_cut(text: str, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], agree: int) -> int | None:
    """A position at which two overlapping encodings may be joined, or None.

    ``left`` and ``right`` hold (start, end, id) in positions of the whole text.
    The position starts a token in both, has white space on one side and none on
    the other (no pre-tokenizer or merge reaches over it), and the ``agree`` tokens
    on either side are the same in both.
    """
    at = {s: i for i, (s, _, _) in enumerate(right)}
    for i in range(len(left) - agree, agree - 1, -1):
        s = left[i][0]
        j = at.get(s)
        if j is None or j < agree or s == 0 or (text[s - 1] in CUT_SPACE) == (text[s] in CUT_SPACE):
            continue
        if left[i - agree:i + agree] == right[j - agree:j + agree]:
            return s
    return None


def spliced_ids(text: str, encode: Callable[[str], Encoded], chunk: int, overlap: int, agree: int = 8) -> list[int]:
    """Ids of one huge text by overlap resynchronisation.

    Chunk k covers ``chunk`` characters and ``overlap`` more, which the next one
    covers too.  Where no stable boundary lies in the overlap, it is doubled, at
    last to the end of the text (one encoding of all the rest), so the result
    never depends on luck.
    """
    def window(a: int, b: int) -> list[tuple[int, int, int]]:
        ids, spans = encode(text[a:b])
        return [(s + a, e + a, i) for i, (s, e) in zip(ids, spans)]

    out: list[int] = []
    begin = 0
    done = 0
    end = min(len(text), chunk + overlap)
    left = window(0, end)
    while end < len(text):
        wide = overlap
        while True:
            begin = max(done, end - wide)
            far = min(len(text), begin + chunk + overlap)
            right = window(begin, far)
            cut = stable_cut(text, [t for t in left if t[0] >= begin], right, agree)
            if cut is not None and cut > done or begin == done:
                break
            wide *= 2
        if cut is None or cut <= done:  # the overlap reaches back to the last cut: encode more at once
            end = min(len(text), end + 2 * (end - done))
            left = window(done, end)
            continue
        out += [i for s, _, i in left if s < cut]
        done, end = cut, far
        left = [t for t in right if t[0] >= cut]
    return out + [i for _, _, i in left]
