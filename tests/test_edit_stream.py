"""Edits as a stream with state against the same edits as a table."""

import random

import pandas as pd
from inkveil.streaming import pages as S

COLUMNS = [c.split()[0] for c in S.EVENT.split(", ")]


def events(seed):
    rng = random.Random(seed)
    out = []
    for page in range(6):
        size = {"width": 400.0, "height": 300.0}
        for b in range(3):
            out.append({"doc_id": 1, "page_no": page, "box_id": f"b{b}", "kind": "seed", "x": 10.0 * b, "y": 20.0, "w": 40.0, "h": 30.0, "label": "Name", "source": "auto", "style": "block", "enabled": True, **size})
        for seq in range(8):
            kind = rng.choice(["move", "resize", "relabel", "toggle", "restyle", "delete", "draw"] if seq > 4 else ["move", "resize", "relabel", "toggle", "draw"])
            e = {"doc_id": 1, "page_no": page, "box_id": f"b{rng.randrange(3)}" if kind != "draw" else f"d{rng.randrange(2)}", "seq": seq, "kind": kind, **size}
            e |= {"move": {"dx": rng.uniform(-50, 50), "dy": 5.0}, "resize": {"handle": "se", "dx": 9.0, "dy": rng.uniform(-60, 9)}, "relabel": {"label": rng.choice(["PAN", "Other"])}, "toggle": {"enabled": rng.random() < 0.5}, "restyle": {"style": "blur"}, "delete": {}, "draw": {"x": 5.0, "y": 6.0, "w": rng.choice([3.0, 60.0]), "h": 20.0, "label": "Signature"}}[kind]
            out.append(e)
    return out


def rows(spark, some):
    return spark.createDataFrame([tuple(e.get(c) for c in COLUMNS) for e in some], S.EVENT)


def stream(spark, parts, place, stop=None):
    """The boxes that stay after the parts came as batches, in order; stopped and started anew after ``stop``."""
    kept, batches = {}, []

    def save(boxes, pages, number):
        changed = {tuple(r) for r in pages.collect()}
        for k in [k for k in kept if k[:2] in changed]:
            del kept[k]
        kept.update({(r["doc_id"], r["page_no"], r["box_id"]): tuple(r) for r in boxes.collect()})
        batches.append((number, changed))

    source = f"{place}/in"
    for i, part in enumerate(parts):
        rows(spark, part).coalesce(1).write.mode("append").parquet(source)
        if stop is None or i in (stop, len(parts) - 1):
            live = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
            S.edit_log(live, save, f"{place}/checkpoint").awaitTermination()
    return kept, batches


def test_any_split_gives_what_one_fold_gives(spark, tmp_path):
    all_ = events(1)
    seeds, edits = [e for e in all_ if e["kind"] == "seed"], [e for e in all_ if e["kind"] != "seed"]
    want = {(r["doc_id"], r["page_no"], r["box_id"]): tuple(r) for r in S.folded(rows(spark, all_)).collect()}
    assert want and len({k[1] for k in want}) == 6
    rng = random.Random(2)
    rng.shuffle(edits)  # late ones too
    late = [e | {"x": 99.0} for e in seeds]  # a page is seeded once
    parts = [seeds + edits[:9], edits[9:20] + late[:6], edits[20:30] + edits[:4], edits[30:]]
    got, batches = stream(spark, parts, str(tmp_path / "a"), stop=1)
    assert got == want, [(got.get(k), want.get(k), [e for e in edits if (e["page_no"], e["box_id"]) == k[1:]]) for k in {**got, **want} if got.get(k) != want.get(k)][:1]
    assert len(batches) == 4 and any(len(changed) < 6 for _, changed in batches)  # pages without news are left alone
    first = [edits[:5], seeds + edits[5:]]  # edits before their page is seeded
    assert stream(spark, first, str(tmp_path / "b"))[0] == want
