"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

Blocks carry ancestor-tag and text features (``page_blocks``). A two-label chain is trained on labelled pages
(``page_labels``) by maximum likelihood with forward-backward sums, all pages at once, and decoded by Viterbi. Blocks
that the best path calls main text are joined in page order by one space; nothing is capped.

Null html counts as empty and gives an empty text. A page may be of any length and nesting: it is read in time linear in
its length. Rows keep their multiplicity, equal pages give equal texts; ids and urls may be null. On a tie between labels
a block is not main text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_arrow, texts_of
from .page_blocks import Block, blocks, describe
from .page_labels import labelled_pages

#: Labelled pages to train on.
TRAINING_PAGES = 900
ROUNDS = 160
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_main int"


class Chain:
    """Weights of the field: a feature speaks for main text if positive; ``turn[x][y]`` is the weight of label y after x."""

    def __init__(self, weights: dict[str, float], turn: list[list[float]]) -> None:
        self.weights, self.turn = weights, turn

    def decode(self, found: list[Block]) -> list[bool]:
        """The most probable labels, by Viterbi."""
        get, (stay0, to1), (to0, stay1) = self.weights.get, *self.turn
        back: list[tuple[bool, bool]] = []
        off = on = 0.0
        for i, b in enumerate(found):
            score = sum([get(f, 0.0) for f in b.features])
            if i == 0:
                off, on = 0.0, score
                continue
            from_on0, from_on1 = on + to0 > off + stay0, on + stay1 > off + to1
            off, on = (on + to0 if from_on0 else off + stay0), (on + stay1 if from_on1 else off + to1) + score
            back.append((from_on0, from_on1))
        labels = [on > off] if found else []
        for from_on0, from_on1 in reversed(back):
            labels.append(from_on1 if labels[-1] else from_on0)
        return labels[::-1]


def align(page: str, truth: list[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
    """Blocks of a labelled page with their labels; each block's text is looked up in page order."""
    found, labels, at = blocks(page), [], 0
    describe(found)
    for b in found:
        k = next((k for k in range(at, len(truth)) if " ".join(truth[k][0].split()) == b.text), None)
        labels.append(truth[k][1] if k is not None else False)
        at = k + 1 if k is not None else at
    return found, labels


def train(pages: list[tuple[str, list[tuple[str, bool]]]], rounds: int = ROUNDS, hold: float = 0.002) -> Chain:
    """Maximum likelihood by Adam steps over all pages at once."""
    known = [align(*p) for p in pages]
    known = [k for k in known if k[0]]
    names = sorted({f for found, _ in known for b in found for f in b.features})
    place = {f: i for i, f in enumerate(names)}
    longest, total = max(len(f) for f, _ in known), len(known)
    x = np.zeros((total, longest, len(names)), np.float32)
    y, real = np.zeros((total, longest), np.int64), np.zeros((total, longest), bool)
    for i, (found, labels) in enumerate(known):
        for t, (b, label) in enumerate(zip(found, labels)):
            x[i, t, [place[f] for f in b.features]] = 1
            y[i, t], real[i, t] = label, True
    flat = x.reshape(-1, len(names))
    w, turn = np.zeros(len(names)), np.zeros((2, 2))
    pairs = real[:, 1:]
    seen_turn = np.array([[(pairs & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    size = real.sum()
    step, m, v = 0.15, np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for k in range(1, rounds + 1):
        score = np.stack((np.zeros_like(y, float), (flat @ w.astype(np.float32)).reshape(y.shape).astype(float)), axis=2)
        forward, backward = np.zeros((total, longest, 2)), np.zeros((total, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp(forward[:, t - 1, :1] + turn[0], forward[:, t - 1, 1:] + turn[1]) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], moved, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            moved = np.logaddexp(turn[:, 0] + ahead[:, :1], turn[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(real[:, t + 1, None], moved, backward[:, t + 1])
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) * real
        joint = forward[:, :-1, :, None] + turn[None, None] + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        slope = np.concatenate((flat.T @ ((y - p) * real).reshape(-1).astype(np.float32), (seen_turn - expected).reshape(-1))) / size
        slope -= hold * np.concatenate((w, turn.reshape(-1)))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, turn = w + move[:-4], turn + move[-4:].reshape(2, 2)
    return Chain({f: float(w[i]) for f, i in place.items()}, turn.tolist())


@lru_cache(maxsize=1)
def trained() -> Chain:
    return train(labelled_pages(TRAINING_PAGES))


def main_text(page: str, chain: Chain) -> tuple[str, int, int]:
    """The main text, the number of blocks and of those taken."""
    found = blocks(page)
    describe(found)
    taken = [b.text for b, main in zip(found, chain.decode(found)) if main]
    return " ".join(taken), len(found), len(taken)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` for every page."""
    chain = chain or trained()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int32()), ("n_main", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(page, chain) for page in texts_of(b.column(2))]
            yield batch(out, {"page_id": b.column(0), "url": b.column(1), "text": [f[0] for f in found], "n_chars": [len(f[0]) for f in found], "n_blocks": [f[1] for f in found], "n_main": [f[2] for f in found]})

    return map_arrow(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), work, SCHEMA)
