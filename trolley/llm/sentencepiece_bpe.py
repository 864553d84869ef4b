"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by piece score (best first, then leftmost)
and merges until no pair is a piece; what stays outside the vocabulary becomes byte pieces.
A merge never crosses a place that no piece crosses. No piece of the vocabulary holds the space mark
after another character, or a letter of an alphabet next to any other character (both are checked when it
is loaded), so a text is cut there, and each distinct cut is merged once per worker while a bounded
memo keeps it. In every Arrow batch the cuts merged anew are checked against the sentencepiece
library, and the whole ids are decoded by it.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame

from trolley.llm.common import map_batches

SPACE = "▁"
MEMO_ENTRIES = 300_000   # of each of two generations
MEMO_CHARS = 64
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string, agrees boolean"
GUARD = "\n"            # stands before a cut in checks; no piece joins it to anything
_WORD = "A-Za-z\u00c0-\u1fff"   # letters of alphabets, with their marks
_CUT = re.compile(f"{SPACE}*[{_WORD}]+|{SPACE}*[^{_WORD}{SPACE}]+|{SPACE}+")
_LOADED: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, and the merge agenda over them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.bytes = [lib.unk_id()] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece] = i
                scores[piece] = lib.get_score(i)
        if any(len(_CUT.findall(p)) > 1 or GUARD in p for p in self.ids):
            raise ValueError(f"{model_file}: a piece crosses the places where texts are cut")
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[x] for piece, x in scores.items()}   # equal scores: leftmost pair first
        self.end = lib.eos_id()
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.guard_ids = self.merge(SPACE + GUARD)

    def merge(self, text: str) -> list[int]:
        """Ids of marked text by the agenda: pop the best pair, join it, offer its new neighbours."""
        part: list[str] = list(text)
        n = len(part)
        rank, push, pop = self.rank, heapq.heappush, heapq.heappop
        agenda = []
        for left in range(n - 1):
            joined = part[left] + part[left + 1]
            r = rank.get(joined)
            if r is not None:
                agenda.append((r, left, left + 1, joined))
        heapq.heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, left, right, joined = pop(agenda)
            a, b = part[left], part[right]
            if not a or not b or len(a) + len(b) != len(joined):
                continue   # one of the two was merged since
            part[left], part[right] = joined, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                more = joined + part[nxt]
                r = rank.get(more)
                if r is not None:
                    push(agenda, (r, left, nxt, more))
            prv = before[left]
            if prv >= 0:
                more = part[prv] + joined
                r = rank.get(more)
                if r is not None:
                    push(agenda, (r, prv, left, more))
        ids, out = self.ids, []
        for piece in part:
            if piece:
                known = ids.get(piece)
                if known is not None:
                    out.append(known)
                else:
                    out.extend([self.bytes[b] for b in piece.encode()])
        return out

    def encode(self, text: str, fresh: dict[str, list[int]]) -> list[int]:
        """Ids of a whole text with the end id; cuts merged now are added to ``fresh``."""
        out: list[int] = []
        if text:
            memo = self.memo
            for cut in _CUT.findall(SPACE + text.replace(" ", SPACE)):
                ids = memo.get(cut)
                if ids is None:
                    ids = memo[cut] = self._recall(cut, fresh)
                    if len(memo) >= MEMO_ENTRIES:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    elif len(cut) > MEMO_CHARS:
                        del memo[cut]
                out += ids
        out.append(self.end)
        return out

    def _recall(self, cut: str, fresh: dict[str, list[int]]) -> list[int]:
        ids = self.older.get(cut)
        if ids is None:
            ids = fresh[cut] = self.merge(cut)
        return ids

    def forget(self, cut: str) -> None:
        self.memo.pop(cut, None)
        self.older.pop(cut, None)

    def wrong(self, fresh: dict[str, list[int]]) -> set[str]:
        """The cuts whose ids differ from the library's, which sees each cut after the guard."""
        cuts = list(fresh)
        theirs = self.library.encode([GUARD + c.replace(SPACE, " ") for c in cuts], num_threads=1) if cuts else []
        return {c for c, ids in zip(cuts, theirs) if ids != self.guard_ids + fresh[c]}


def vocabulary(model_file: str) -> Vocabulary:
    if model_file not in _LOADED:
        _LOADED[model_file] = Vocabulary(model_file)
    return _LOADED[model_file]


def _encode_batch(pdf: pd.DataFrame, model_file: str, with_text: bool) -> pd.DataFrame:
    v = vocabulary(model_file)
    texts = [t if isinstance(t, str) else "" for t in pdf["text"].array]
    encoded, cuts = [], []
    fresh: dict[str, list[int]] = {}
    for t in texts:
        new: dict[str, list[int]] = {}
        encoded.append(v.encode(t, new))
        cuts.append(new)
        fresh |= new
    wrong = v.wrong(fresh)
    for cut in wrong:
        v.forget(cut)   # so that every text holding it is checked, and told, again
    decoded = [v.library.decode(ids) for ids in encoded]
    out = pd.DataFrame({
        "doc_id": pdf["doc_id"].astype("Int64"),
        "n_tokens": [len(ids) for ids in encoded],
        "ids_sha256": [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in encoded],
        "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
        "decoded": decoded if with_text else None,
        "agrees": [not any(c in wrong for c in new) for new in cuts],
    })
    out["decoded"] = out["decoded"].astype(object)
    return out


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                  with_text: bool = False) -> DataFrame:
    """Token count, digests of the ids and of the decoded text, one output row per input row.

    A null text is encoded as the empty one (the end id alone). Whole texts of any length are
    encoded; repeated rows repeat their result; other columns are not read. ``agrees`` is false where
    the agenda and the library differ; ``decoded`` holds the text if ``with_text``.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_batches(rows, lambda pdf: _encode_batch(pdf, model_file, with_text), SCHEMA)


def encode_ids(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``: the ids themselves, for training files."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(model_file)
        ids = [v.encode(t if isinstance(t, str) else "", {}) for t in pdf["text"].array]
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids})

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_batches(rows, run, "doc_id long, ids array<int>")
