import random

from termweave.operators import redundancy
from termweave.operators.enrich import Limits


def greedy(cands, carried, jaccard):
    """cands in order of rank: (rank, stems)."""
    heads, out = [], {}
    for rank, stems in cands:
        for head, head_stems in heads:
            shared = len(carried[rank] & carried[head])
            union = len(carried[rank] | carried[head])
            nested = stems <= head_stems or head_stems <= stems
            if shared and (shared / union >= jaccard or (nested and shared / min(len(carried[rank]), len(carried[head])) >= 0.5)):
                out[rank] = head
                break
        else:
            heads.append((rank, stems))
            out[rank] = rank
    return out


def test_groups_as_a_plain_loop_gives_them(spark):
    pick = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    rows, hits, wanted = [], [], {}
    for name in ("s1", "s2"):
        carried, cands = {}, []
        for rank in range(1, 31):
            carried[rank] = set(pick.sample([f"e{i}" for i in range(14)], pick.randint(2, 9)))
            label = " ".join(pick.sample(words, pick.randint(1, 2)))
            cands.append((rank, set(label.split())))
            rows.append((name, rank, f"c{rank}", label, len(carried[rank]), "significant"))
            hits += [(name, rank, f"c{rank}", e) for e in carried[rank]]
        assert name != "s1" or len({h for h in greedy(cands, carried, 0.6).values()}) < 30
        wanted |= {(name, r): h for r, h in greedy(cands, carried, 0.6).items()}
    results = spark.createDataFrame(rows, "set_id string, rank int, concept string, label string, k_study long, status string")
    held = spark.createDataFrame(hits, "set_id string, rank int, concept string, entity_id string")
    got = redundancy.merge_groups(results, held, Limits(merge_jaccard=0.6)).collect()
    assert {(r.set_id, r.rank): r.group_rank for r in got} == wanted
    assert {r.group_rank for r in redundancy.merge_groups(results, held, Limits(merge_jaccard=0)).collect()} == {1}


def test_a_long_line_of_neighbours_is_decided_in_order(spark):
    rows = [("s", rank, f"c{rank}", f"w{rank}", 4, "significant") for rank in range(1, 13)]
    hits = [("s", rank, f"c{rank}", f"e{rank + i}") for rank in range(1, 13) for i in range(4)]
    results = spark.createDataFrame(rows, "set_id string, rank int, concept string, label string, k_study long, status string")
    held = spark.createDataFrame(hits, "set_id string, rank int, concept string, entity_id string")
    got = redundancy.merge_groups(results, held, Limits(merge_jaccard=0.6)).collect()
    assert {r.rank: r.group_rank for r in got} == {r: r - (r + 1) % 2 for r in range(1, 13)}
    assert redundancy.merge_groups(results.where("false"), held, Limits()).count() == 0
