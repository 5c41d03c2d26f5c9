"""Plain answers to compare with."""

import re

import numpy as np


def grams(text):
    out = set()
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        out |= {padded[i:i + 3] for i in range(len(padded) - 2)}
    return out


def similarity(a, b):
    a, b = grams(a), grams(b)
    return round(len(a & b) / len(a | b), 6) if a | b else 0.0


def distance(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not a.any() or not b.any():
        return None
    return round(float(1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 6) + 0.0


def in_scope(q, i):
    return (
        (q.get("eff_min") is None or (i["atk"] is not None and i["atk"] >= q["eff_min"]))
        and (q.get("eff_max") is None or (i["atk"] is not None and i["atk"] <= q["eff_max"]))
        and (q.get("min_def") is None or (i["def_"] is not None and i["def_"] >= q["min_def"]))
        and (q.get("max_def") is None or (i["def_"] is not None and i["def_"] <= q["max_def"]))
        and (q.get("level") is None or i["level"] == q["level"])
        and (q.get("attribute") is None or i["attribute"] == q["attribute"])
        and (q.get("card_type") is None or q["card_type"] in (i["properties"] or []))
    )


def vector_list(q, items, k):
    found = [
        (distance(q["query_vec"], i["embedding"]), i["item_id"])
        for i in items
        if i["embedding"] is not None and q["query_vec"] is not None and in_scope(q, i)
    ]
    return [(i, d) for d, i in sorted(f for f in found if f[0] is not None)[:k]]


def lexical_list(q, items, k, threshold=0.3):
    if q["search_text"] is None:
        return []
    found = [
        (round(1 - similarity(q["search_text"], i["name"]), 6), i["item_id"])
        for i in items
        if i["name"] is not None and in_scope(q, i) and similarity(q["search_text"], i["name"]) >= threshold
    ]
    return [(i, d) for d, i in sorted(found)[:k]]


def fused(q, items, pool, mode="left"):
    vec = {i: n for n, (i, _) in enumerate(vector_list(q, items, pool), 1)}
    lex = {i: n for n, (i, _) in enumerate(lexical_list(q, items, pool), 1)}
    ids = set(vec) if mode == "left" else set(vec) | set(lex)
    far = 1_000_000
    score = {i: round(1 / (60 + vec.get(i, far)) + 1 / (60 + lex.get(i, far)), 9) for i in ids}
    return sorted(ids, key=lambda i: (-score[i], i))[:pool]
