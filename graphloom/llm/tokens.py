"""Token ids of whole texts with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import os
import sys

import numpy as np

from graphloom.llm.text import coded, release

WORD_BPE = "word_bpe_49k.json"
#: Distinct words whose ids one Python worker keeps; beyond it the memory starts afresh, results are the same.
CACHE_WORDS = 800_000
#: Words whose ids are laid out at a time: what is built for them is small beside the ids of a part of texts.
AT_ONCE = 1 << 16
_ENDS = frozenset(",.")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def vocabulary(path: str) -> str:
    """The vocabulary file as a string: a fixed 1 to 2 MB, shipped with the tasks so that executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space, so that words between blanks are encoded apart.

    encode() gives (offsets, ids): text i has ids[offsets[i]:offsets[i+1]], with `end` appended where it is not None. At most
    `cache_words` distinct words and their ids are kept between calls, besides those of one call.
    """

    def __init__(self, source: str, end: int | None = 0, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each Spark task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        # a text that has a special token is encoded whole, by a plain tokenizer made when one comes; words are never such tokens
        self.source, self.plain = source, None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True
        pre = json.dumps(json.loads(source)["pre_tokenizer"])
        if r"[^\\s\\p{L}\\p{N}]+" not in pre or "Removed" not in pre or "</w>" not in source:
            raise ValueError("the tokenizer must drop white space and split letters from other signs")
        known = self.tokenizer.get_vocab()
        self.last = np.zeros(max(known.values()) + 1, bool)
        self.last[[i for t, i in known.items() if t.endswith("</w>")]] = True
        self.end, self.cache_words = end, cache_words
        self.ids: dict[str, bytes] = {}

    def _fill(self, new: list[str]) -> None:
        ids = self.ids
        self._single([w for w in new if w.isalpha()])
        todo = [w for w in new if w not in ids]
        for w, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
            ids[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _single(self, plain: list[str], at_once: int = 2000) -> None:
        """Words of letters alone are one pre-token each, so many are encoded as one text and parted after each word's end."""
        for k in range(0, len(plain), at_once):
            part = plain[k : k + at_once]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            got = np.array(found.ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[got]) + 1) * 4
            if len(ends) == len(part):  # else a letter that case or composition takes apart; they are encoded one by one
                raw, begin = got.tobytes(), 0
                for w, e in zip(part, ends.tolist(), strict=True):
                    self.ids[w] = raw[begin:e]
                    begin = e

    def encode(self, texts):
        import pyarrow.compute as pc

        offsets, ids = self._words(texts)
        extra = int(self.end is not None)
        found = {}
        for k in {int(k) for t in self.special for k in np.flatnonzero(pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False))}:
            if self.plain is None:
                self.plain = type(self.tokenizer).from_str(self.source)
            found[k] = np.array(self.plain.encode(texts[k].as_py(), add_special_tokens=False).ids + [self.end] * extra, dtype="<u4")
        if not found:
            return offsets, ids
        parts = [found.get(k, ids[b:e]) for k, (b, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
        return np.cumsum([0] + [len(p) for p in parts]), np.concatenate(parts)

    def _words(self, texts):
        offsets, codes, uniques = coded(texts, lower=True)
        # a letter and then one comma or full stop at a word's end are two pre-tokens: the ids of the stem, then the sign's
        stems = [w[:-1] if w[-1:] in _ENDS and w[-2:-1].isalpha() else w for w in uniques]
        new = [w for w in {*stems, ",", "."} if w not in self.ids]
        if new and len(self.ids) + len(new) > self.cache_words:
            self.ids.clear()
            new = list({*stems, ",", "."})
        self._fill(new)
        ids = self.ids
        found = [ids[s] if s is w else ids[s] + ids[w[-1]] for w, s in zip(uniques, stems, strict=True)]
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter((len(x) // 4 for x in found), np.int32, len(found))
        start = np.cumsum(size, dtype=np.int64) - size
        del found, stems, uniques
        extra = int(self.end is not None)
        upto = np.zeros(len(codes) + 1, np.int64)
        for k in range(0, len(codes), AT_ONCE):
            np.cumsum(size[codes[k : k + AT_ONCE]], out=upto[k + 1 : k + 1 + AT_ONCE])
            upto[k + 1 : k + 1 + AT_ONCE] += upto[k]
        out_offsets = upto[offsets] + extra * np.arange(len(offsets))
        ids = np.full(int(out_offsets[-1]), self.end or 0, dtype="<u4")
        keep = np.ones(len(ids), bool)
        if extra:
            keep[out_offsets[1:] - 1] = False
        for k in range(0, len(codes), AT_ONCE):
            part = codes[k : k + AT_ONCE]
            before = upto[k : k + 1 + len(part)]
            at = np.arange(before[0], before[-1])
            at -= np.repeat(before[:-1] - start[part], size[part])
            # from the first word's place to the last one's: texts that end between have their `end` there
            first, last = np.searchsorted(offsets, (k, k + len(part) - 1), side="right") - 1
            here = slice(before[0] + extra * first, before[-1] + extra * last)
            ids[here][keep[here]] = pool[at]
        return out_offsets, ids


def encoder(source: str, end: int | None = 0, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """This worker process's encoder; kept between tasks, as a process serves many."""
    kept = sys.__dict__.setdefault("_graphloom_encoders", {})
    key = (hash(source), end, cache_words)
    if key not in kept:
        kept[key] = WordEncoder(source, end, cache_words)
    return kept[key]


def forget() -> None:
    """Give back the memory that encoders of earlier tasks hold in this worker process."""
    sys.__dict__.pop("_graphloom_encoders", None)
    release()
