"""Token counts of whole documents, with overlap resynchronisation for huge ones.

A document of up to ``chunk_chars`` characters is encoded in one call. A longer one is encoded in chunks that
overlap; each chunk's tokens carry their offsets, and two neighbours are spliced at a position in their overlap
where both have a token start and where no vocabulary piece can reach across. For the vocabularies used here such a
position is a white-space mark behind another character: ``proven_marks`` checks that no piece holds a mark behind
another character, so what stands on either side is encoded independently. So is a line end or tab that ``lone`` finds
in no piece beside another character. If an overlap holds no such position it is widened, in the end to the whole
document, so the count never depends on the chunking.

Null text counts as empty (0 tokens). Rows keep their multiplicity; ``doc_id`` may be null. A text may be of any length; of
several positions to splice at the first is taken. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_arrow, texts_of

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
LIMIT = 4096
MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"


@lru_cache(maxsize=4)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def proven_marks(path: str) -> bool:
    """Whether no piece of the vocabulary holds a white-space mark behind another character."""
    model = load(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:]))


@lru_cache(maxsize=4)
def lone(path: str) -> frozenset[str]:
    """White space that the vocabulary joins with nothing; the library's normalisation leaves it as it is."""
    model = load(path)
    joined = {c for i in range(model.get_piece_size()) for c in model.id_to_piece(i) if len(model.id_to_piece(i)) > 1 and not model.is_byte(i)}
    alone = lambda c: len(model.encode(f"a{c}b")) == len(model.encode("a")) + len(model.encode(f"{c}b")) - 1  # noqa: E731  a mark before the second
    return frozenset(c for c in "\n\t\r" if c not in joined and alone(c))


def starts(model, text: str, at: int) -> list[int]:
    """Offsets in the document at which the tokens of ``text``, which begins at ``at``, start.

    The library puts a mark before the first character; a chunk therefore begins behind a white space that this mark
    stands for, or with a character that joins with nothing, whose mark is left out; or it is the document's start.
    """
    found = model.encode(text, return_type="offset_mapping")
    return [at + p for p, _ in found["offsets"]]


def stable(text: str, p: int, alone: frozenset[str]) -> bool:
    return text[p] in alone or text[p] in " ▁" and text[p - 1] not in " ▁"


def splice(text: str, left: list[int], right: list[int], lo: int, hi: int, alone: frozenset[str]) -> int | None:
    """The first position in ``[lo, hi)`` where both encodings have a token start that no piece can cross."""
    common = set(left).intersection(right)
    return min((p for p in common if lo <= p < hi and p > 0 and stable(text, p, alone)), default=None)


def count_spliced(model, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, alone: frozenset[str] = frozenset()) -> tuple[int, int, int]:
    """Tokens of the text, the number of chunks and how often an overlap had to be widened; ``alone`` are characters that join with nothing."""
    n, total, chunks, widened = len(text), 0, 1, 0
    begin, start, end = 0, 0, min(chunk, n)  # tokens count from begin; the current chunk is text[start:end]
    have, bare = starts(model, text[start:end], start), 0  # bare: 1 if the chunk's first mark is not the document's
    while end < n:
        wide, cut = overlap, None
        while True:
            # the next chunk's text begins behind a white space, which the library's own mark replaces, or with a lone one
            at = max(end - wide, begin)
            further = next((p for p in range(at, end) if p > begin and stable(text, p, alone) and (text[p] == " " or text[p] in alone)), None)
            if further is not None:
                behind = text[further] == " "
                stop = min(n, further + behind + chunk + wide)
                then = starts(model, text[further + behind : stop], further + behind)
                # its first token stands for the white space before it as well, or is a mark that the document does not have
                then = [further, *then[1:]] if behind else then[1:]
                cut = splice(text, have, then, further, end, alone)
            if cut is not None:
                break
            widened += 1
            wide *= 2
            if end - wide <= begin:  # nothing left to widen to the left: take in more on the right
                end = min(n, end + wide)
                have = starts(model, text[start:end], start)[bare:]
                if end == n:
                    break
        if cut is None:
            break
        total += sum(begin <= p < cut for p in have)
        begin, start, end, have, bare = cut, further + behind, stop, then, 1 - behind
        chunks += 1
    return total + sum(p >= begin for p in have), chunks, widened


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened``."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32()), ("n_widened", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, may_cut, alone = load(model_path), proven_marks(model_path), lone(model_path)
        for b in batches:
            texts = texts_of(b.column(1))
            short = [i for i, t in enumerate(texts) if len(t) <= chunk or not may_cut]
            found = [(0, 1, 0)] * len(texts)
            for i, ids in zip(short, model.encode([texts[i] for i in short], num_threads=1) if short else []):
                found[i] = (len(ids), 1, 0)
            for i in set(range(len(texts))).difference(short):
                found[i] = count_spliced(model, texts[i], chunk, overlap, alone)
            yield batch(
                out,
                {
                    "doc_id": b.column(0),
                    "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": [f[0] for f in found],
                    "over_limit": [f[0] > limit for f in found],
                    "n_chunks": [f[1] for f in found],
                    "n_widened": [f[2] for f in found],
                },
            )

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, SCHEMA)
