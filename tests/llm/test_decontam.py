import random

import brute
from ripple.llm import decontam


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 7)
    r = random.Random(1)
    word = lambda: f"w{r.randint(0, 10**6)}"
    items = {i: [word() for _ in range(r.choice([1, 3, 5, 6, 9, 20, 44, 61, 130, 700]))] for i in range(30)}
    docs = []
    for i in range(120):
        body = [word() for _ in range(r.choice([0, 4, 30, 500, 9000]))]
        for _ in range(r.randint(0, 2)):
            part = list(items[r.randint(0, 29)])
            if r.random() < 0.4 and len(part) > 5:  # some miss a few words
                part[r.randrange(len(part))] = word()
            at = r.randint(0, len(body))
            body[at:at] = part
        docs.append((i, " ".join(body).upper() if i % 3 else " \n".join(body), "clash"))
    docs += [(None, " ".join(items[7]), "c"), (5, " ".join(items[7]), "c"), (5, " ".join(items[7]), "c"), (900, None, "c"), (901, "", "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(7, " ".join(items[7])), (98, None), (99, " ")], "item_id long, text string")
    want = []
    sets = {i: brute.shingles(" ".join(w), 5) for i, w in items.items()}
    for k, t, _ in docs:
        own = brute.shingles(t, 5)
        want += [(str(k), i, len(s), len(s & own)) for i, s in sets.items() if len(s & own) >= 0.8 * len(s)]
    got = decontam.contained_items(frame, table).collect()
    assert sorted((str(x.doc_id), x.item_id, x.n_shingles, x.n_shared) for x in got) == sorted(want)
    assert len(want) > 50
    clean = decontam.clean_documents(frame, table)
    dirty = {w[0] for w in want}
    assert clean.columns == frame.columns and clean.count() == sum(str(k) not in dirty for k, *_ in docs)
    assert decontam.contained_items(frame, table.limit(0)).collect() == [] and decontam.clean_documents(frame.limit(0), table).collect() == []


def test_index_of_a_block_is_small():
    """Every Python worker holds a copy, beside what earlier stages left there."""
    import pickle
    index = decontam.ItemIndex([1, 2, 3], ["a b c d e f", " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(900))])
    assert len(index.by_class) == 3 and len(pickle.dumps(index)) < 2 << 20
