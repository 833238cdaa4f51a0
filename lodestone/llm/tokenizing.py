"""Encoding with the tokenizers library, memoised over word-sized pieces.

A byte-pair encoder never merges over the borders that its pre-tokenizer sets. Both public tokenizers set a border at a
single space between two words, so a text can be cut there, each distinct piece encoded once by the library, and the ids
joined. Pieces whose borders are not certain go to the library uncut. The ids are those of the whole text.

Cutting, finding the distinct pieces of about ``CHUNK_BYTES`` of texts, looking up their ids and joining them are Arrow and
numpy operations over all words at once; Python sees a piece only when it is not in the worker's store. The store knows a
piece by 128 bits of tabulation hashing, with tables drawn anew in each worker.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm._common import worker_cache

STORE_PIECES = 1_000_000  # pieces whose ids a worker keeps, about 40 bytes each; the half that was not used for longest goes
STORED_BYTES = 48  # longer pieces are not kept
CHUNK_BYTES = 2 << 20  # texts that are cut at a time; a longer text is a chunk of its own
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?"  # after letters, each is a unit of its own
_GROUP = 256  # new pieces that go to the library as one text
_MARK = "~"  # stands between pieces, as one id or few; a piece that holds it goes alone


def resolve(tokenizer: str) -> str:
    """A file's path, or the path of a public tokenizer's file by its name."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class _Store:
    """Ids of pieces by the pieces' hashes, in sorted arrays."""

    def __init__(self, most: int, ids: np.dtype):
        self.most, self.turn = most, 0
        self.table = np.random.default_rng().integers(0, 1 << 64, (STORED_BYTES << 8, 2), np.uint64)
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begins, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, ids)

    def hashes(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each piece of at most ``STORED_BYTES``, the sum of a random number for each byte at its place; and which those are."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(pieces) else np.zeros(0, np.uint8)
        begins, n = offsets[:-1] - offsets[:1], np.diff(offsets)
        place = np.arange(len(data), dtype=np.int32) - np.repeat(begins, n)
        terms = self.table[(np.minimum(place, STORED_BYTES - 1) << 8) + data]
        sums = np.zeros((len(n), 2), np.uint64)
        some = n > 0
        if some.any():
            sums[some] = np.add.reduceat(terms, begins[some], axis=0)
        return sums, n <= STORED_BYTES

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it does."""
        if not len(self.keys):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        order = np.argsort(hashed[:, 0])
        at = np.empty(len(hashed), np.int64)
        at[order] = np.searchsorted(self.keys, hashed[order, 0])
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == hashed[:, 0]) & (self.checks[at] == hashed[:, 1])
        self.used[at[hit]] = self.turn
        return at, hit

    def add(self, hashed: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(hashed[:, 0])
        at = np.searchsorted(self.keys, hashed[order, 0])
        self.keys, self.checks = np.insert(self.keys, at, hashed[order, 0]), np.insert(self.checks, at, hashed[order, 1])
        self.begins, self.sizes = np.insert(self.begins, at, begins[order]), np.insert(self.sizes, at, sizes[order])
        self.used = np.insert(self.used, at, self.turn)

    def tidy(self) -> None:
        self.turn += 1
        if len(self.keys) <= self.most:
            return
        stay = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
        sizes = self.sizes[stay]
        to = np.cumsum(sizes, dtype=np.int64)
        self.flat = self.flat[np.repeat(self.begins[stay] - (to - sizes), sizes) + np.arange(int(to[-1]))]
        self.keys, self.checks, self.used = self.keys[stay], self.checks[stay], self.used[stay]
        self.begins, self.sizes = to - sizes, sizes


class PieceEncoder:
    """``encode(texts)`` gives the ids of all texts, as unsigned integers of type ``ids`` (16 bits where the vocabulary fits), and where each begins."""

    def __init__(self, tokenizer: str, store_pieces: int = STORE_PIECES):
        from tokenizers import Tokenizer

        path = resolve(tokenizer)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # strings that are one id wherever they stand, whatever is beside them: texts that have one go to the library whole
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.ids = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.cut = "space-led"
        elif pre.get("type") == "Sequence" and any(p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed" and r"[^\s" in str((p.get("pattern") or {}).get("Regex")) for p in pre["pretokenizers"]):
            self.cut = "words"
        else:
            self.cut = "none"
        self.mark = np.array(self.library.encode(_MARK if self.cut == "words" else "\n", add_special_tokens=False).ids, dtype=self.ids)
        self.store = _Store(store_pieces, self.ids)
        self.marks = {c: self._ids([c])[0] for c in _MARKS}
        self.newline = self._ids(["\n"])[0]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.ids).tobytes() for e in self.library.encode_batch(pieces, add_special_tokens=False)]

    def _grouped(self, pieces: list[str], lead: str, into: dict[str, bytes | None]) -> None:
        """Puts the ids of ``lead`` + each piece into ``into``: many pieces go in one call, and are divided again at the marks between them."""
        words, alone = self.cut == "words", []
        if words:
            alone = [p for p in pieces if _MARK in p]
            pieces = [p for p in pieces if _MARK not in p] if alone else pieces
        groups = [pieces[k : k + _GROUP] for k in range(0, len(pieces), _GROUP)]
        between = f" {_MARK} " if words else f"\n{lead}"
        width = self.ids.itemsize
        # a call at a time: the library's results take far more memory than the ids
        for g in groups:
            e = self.library.encode_batch_fast([lead + between.join(g)], add_special_tokens=False)[0]
            ids, n = np.array(e.ids, dtype=self.ids), len(self.mark)
            at = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - n + 1 + k] == self.mark[k] for k in range(n)]))
            if len(at) != len(g) - 1:
                alone += g
                continue
            raw, begin, gap = ids.tobytes(), 0, width * n
            for p, stop in zip(g, [*(width * at).tolist(), len(raw)], strict=True):
                into[p] = raw[begin:stop]
                begin = stop + gap
        if alone:
            into.update(zip(alone, self._ids([lead + p for p in alone]), strict=True))

    def _learn(self, new: list[str]) -> list[bytes | None]:
        """The ids of each of the pieces ``new``; None for one whose borders may not hold."""
        known: dict[str, bytes | None] = {}
        stems: dict[str, str] = {}
        after: list[str] = []  # after a line break
        plain = {p for p in new if p.isalpha()}
        for p in new if len(plain) < len(new) else ():
            if p in plain:
                continue
            q = p
            if self.cut == "space-led":
                if not p or p.isspace():
                    known[p] = None
                    continue
                if p[0] == "\n":
                    q = p[1:]
                if q[0].isspace() or q[-1].isspace():
                    known[p] = None
                    continue
            if len(p) > 1 and p[-1] in _MARKS and self._letters(q[:-1]):
                stems[p] = s = p[:-1]
                if s not in plain:
                    after.append(s) if q is not p else plain.add(s)
            elif q is not p:
                after.append(p)
            else:
                plain.add(p)
        if plain:
            self._grouped(list(plain), " " if self.cut == "space-led" else "", known)
        if after:
            ids: dict[str, bytes | None] = {}
            self._grouped(list({p[1:] for p in after}), "", ids)
            known.update((p, self.newline + ids[p[1:]]) for p in after)
        for p, s in stems.items():
            known[p] = known[s] + self.marks[p[-1]]
        return [known[p] for p in new]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text k are ids[offsets[k]:offsets[k + 1]], with ``end_id`` behind them if there is one. Null is empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        whole = None
        for token in self.special:
            has = pc.match_substring(texts, token)
            whole = has if whole is None else pc.or_(whole, has)
        if whole is not None and pc.any(whole).as_py():
            return self._with_whole(texts, whole, end_id)
        lengths, ids, at = [], [], 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")) - at)
            offsets, found = self._chunk(texts.slice(at, n))
            if end_id is not None:
                found = np.insert(found, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            lengths.append(np.diff(offsets))
            ids.append(found)
            at += n
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), np.concatenate(ids) if ids else np.zeros(0, self.ids)

    def _with_whole(self, texts: pa.Array, whole: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` where the texts marked in ``whole`` go to the library as they are."""
        offsets, ids = self.encode(pc.if_else(whole, "", texts), end_id)
        parts = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            one = self._ids([texts[k].as_py()])[0]  # a call at a time, as above
            parts[k] = np.concatenate([np.frombuffer(one, self.ids), parts[k]])
        return self._joined(parts)

    def _letters(self, stem: str) -> bool:
        """Whether the library sees letters alone: normalising may turn a letter into one with a mark of its own."""
        if stem.isascii() or self.library.normalizer is None:
            return stem.isalpha()
        return stem.isalpha() and self.library.normalizer.normalize_str(stem).isalpha()

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.cut == "none":
            return self._joined([np.frombuffer(x, self.ids) for x in self._ids(texts.to_pylist())])
        if self.cut == "words":
            spaced = pc.replace_substring(texts, "\n", " ")
        else:  # a line break in front, whose ids go again, makes the first piece like those of other lines
            spaced = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(spaced, " ")
        coded = lists.values.dictionary_encode()
        which, first, store = coded.indices.to_numpy(), lists.offsets.to_numpy(), self.store
        hashed, short = store.hashes(coded.dictionary)
        at, hit = store.find(hashed)
        hit &= short
        begins, sizes = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int32)
        begins[hit], sizes[hit] = store.begins[at[hit]], store.sizes[at[hit]]
        new, hard = np.flatnonzero(~hit), None
        if len(new):
            found = self._learn(coded.dictionary.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
            unsure = np.fromiter((x is None for x in found), bool, len(found))
            if unsure.any():
                hard = np.zeros(len(hit), bool)
                hard[new[unsure]] = True
                found = [x or b"" for x in found]
            sizes[new] = np.fromiter(map(len, found), np.int64, len(found)) // self.ids.itemsize
            begins[new] = len(store.flat) + np.cumsum(sizes[new]) - sizes[new]
            store.flat = np.concatenate([store.flat, np.frombuffer(b"".join(found), self.ids)])
            kept = new[short[new] & ~unsure]
            store.add(hashed[kept], begins[kept], sizes[kept])
        flat = store.flat
        taken = sizes[which]
        to = np.cumsum(taken, dtype=np.int64)
        n = int(to[-1]) if len(to) else 0
        places = np.repeat((begins[which] - (to - taken)).astype(np.int32 if max(n, len(flat)) < 1 << 31 else np.int64), taken)
        places += np.arange(n, dtype=places.dtype)
        ids, offsets = flat[places], np.concatenate([[0], to])[first]
        store.tidy()
        if self.cut == "space-led" and len(texts):
            lead = len(self.newline) // self.ids.itemsize
            stays = np.ones(len(ids), bool)
            known_lead = np.minimum(lead, np.diff(offsets))  # a text whose first piece is not certain has none
            for k in range(lead):
                stays[offsets[:-1][known_lead > k] + k] = False
            ids, offsets = ids[stays], offsets - np.concatenate([[0], np.cumsum(known_lead)])
        if hard is not None:
            odd = np.flatnonzero(np.logical_or.reduceat(hard[which], first[:-1]))
            parts = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for k in odd.tolist():
                uncertain = _BORDER.split(texts[k].as_py())
                parts[k] = np.frombuffer(b"".join(self._ids([uncertain[0], *(" " + p for p in uncertain[1:])])), self.ids)
            return self._joined(parts)
        return offsets, ids

    def _joined(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts) if parts else np.zeros(0, self.ids)


def encoder(tokenizer: str, store_pieces: int = STORE_PIECES) -> PieceEncoder:
    """The worker's encoder, loaded once; a worker keeps the last one it used. A piece takes about 40 bytes of memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    cache, key = worker_cache(), (tokenizer, store_pieces)
    if cache.get("encoder", (None,))[0] != key:
        cache["encoder"] = (key, PieceEncoder(tokenizer, store_pieces))
    return cache["encoder"][1]
