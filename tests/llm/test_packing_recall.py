"""How many of a seed's true neighbours packing can find: a measurement, with a floor so that a loss is noticed. It is low: see the README."""

import numpy as np
import pyarrow.parquet as pq

from graphloom.llm import packing


def test_share_of_true_neighbours_within_a_seeds_shard(vocab, capsys):
    encode = packing.encoder(vocab("byte_bpe_50k.json"), vocab("byte_bpe_50k.tiktoken"))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    ids = [np.array([*encode(t or ""), 0], np.int64) for t in texts]
    units = [u for u in (x[len(x) // 1024 * 1024 :] for x in ids) if len(u)]
    index, seeds = packing.Index(units), np.random.default_rng(0).choice(len(units), 150, replace=False)
    place = np.empty(len(units), int)
    place[sorted(range(len(units)), key=lambda i: packing.marks(units[i][:-1]))] = np.arange(len(units))
    shard, best, five = place // 1024, [], []
    for s in seeds:
        near = [u for u in index.neighbours(units[s])[:12] if u != s][:5]
        best.append(shard[near[0]] == shard[s])
        five += [shard[u] == shard[s] for u in near]
    with capsys.disabled():
        print(f"\nneighbours in the seed's shard: {np.mean(best):.2f} of the best, {np.mean(five):.2f} of the best five")
    assert np.mean(five) > 0.3 and np.mean(best) > 0.4
