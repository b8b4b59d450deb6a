"""Token counts by the whole-token shortcut.

Where no piece of the vocabulary holds a blank after another character, no merge crosses the start of
a run of blanks, so a text's tokens are those of its pre-tokens (a run of blanks and what follows, up
to the next run). `proven` encodes every vocabulary string of that shape once, offline, and keeps
those that come out as one token: they count one each. Only other pre-tokens are merged, each once
as long as it stays in a memo of bounded size. A vocabulary without that property has its texts
encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import map_arrow

MARK = "▁"
#: Pre-tokens remembered per task beside the proven ones; beyond it the memo starts anew.
MEMO = 400_000
#: A pre-token of more characters is merged each time, so that the memo's bytes are bounded too.
MEMO_CHARS = 64
_PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def splits_at_blanks(pieces: Iterable[str]) -> bool:
    """No piece has a blank after another character."""
    return not any(MARK in p.lstrip(MARK) for p in pieces)


@lru_cache(maxsize=2)
def proven(model: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, each without its first mark and with blanks as blanks."""
    sp = processor(model)
    strings = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    alone = [p[1:].replace(MARK, " ") for p in strings if p.startswith(MARK)]
    return frozenset(t for t, ids in zip(alone, sp.encode(alone, num_threads=1)) if len(ids) == 1 and t)


class Counter:
    """Counts tokens; keeps the memo."""

    def __init__(self, model: str, memo: int = MEMO):
        self.sp, self.whole = processor(model), proven(model)
        self.shortcut = splits_at_blanks(self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        # a lone mark cannot be asked for: the library adds one to a text, but not to an empty one
        lone = 1 if self.sp.piece_to_id(MARK) != self.sp.unk_id() else len(MARK.encode())
        self.known = {**dict.fromkeys(self.whole, 1), "": lone}
        self.most, self.memo = memo, dict(self.known)

    def pretokens(self, text: str) -> list[str]:
        """Each pre-token without its first mark, as the library takes a text (it adds the mark)."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [p[1:].replace(MARK, " ") for p in _PRETOKEN.findall(marked)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.shortcut:
            return [len(ids) for ids in self.sp.encode(texts, num_threads=1)]
        parts = [self.pretokens(t) for t in texts]
        rest = set().union(*parts).difference(self.memo) if parts else set()
        if len(self.memo) + len(rest) > len(self.known) + self.most:
            self.memo = dict(self.known)
            rest = set().union(*parts).difference(self.memo)
        rest = list(rest)
        found = dict(zip(rest, map(len, self.sp.encode(rest, num_threads=1))))
        self.memo.update(found)
        out = [sum(map(self.memo.__getitem__, p)) for p in parts]
        for t in found:
            if len(t) > MEMO_CHARS:
                del self.memo[t]
        return out


def count_tokens(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row.

    Null texts count as empty (0 bytes, 0 tokens); keys may be null or repeat; other columns are not
    looked at; an empty table gives an empty one. One pass over the texts, no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counter.counts([t or "" for t in texts]), pa.int64()), batch.column(2)],
                names=["k", "n", "b"])

    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(
        F.col(key).alias("k"), F.col(text).alias("t"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("b"))
    return map_arrow(narrow, run, f"k {kind}, n bigint, b bigint").select(
        F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"),
        (F.col("n") > limit).alias("over_limit"))
