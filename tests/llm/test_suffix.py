import random

import numpy as np

from coursemill.llm import suffix


def brute(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    prefixes = [0] * len(order)
    for k, (a, b) in enumerate(zip(order, order[1:]), 1):
        while prefixes[k] < cap and text[a + prefixes[k] : a + prefixes[k] + 1] == text[b + prefixes[k] : b + prefixes[k] + 1] != b"":
            prefixes[k] += 1
    return order, prefixes


def test_order_and_prefixes_in_memory_and_on_disk(tmp_path, monkeypatch):
    rng = random.Random(4)
    limits = [{}, {"memory": 0, "in_memory_names": 2, "held": 3}, {"memory": 100, "in_memory_names": 5, "held": 4}]
    for trial in range(60):
        letters = rng.choice([1, 2, 3, 256])
        text = bytes(rng.randrange(letters) for _ in range(rng.choice([0, 1, 2, 9, 60, 250])))
        if trial % 2:
            text = text + text[2:12] * 4 + text
        cap = rng.choice([3, 50])
        monkeypatch.setattr(suffix, "BLOCK", rng.choice([1, 3, 1 << 15]))
        blocks = list(suffix.suffixes(np.frombuffer(text, np.uint8), cap, str(tmp_path), **rng.choice(limits)))
        got = ([int(x) for a, _ in blocks for x in a], [int(x) for _, p in blocks for x in p])
        assert got == brute(text, cap), (trial, letters, cap)
        assert not list(tmp_path.iterdir())  # spilled files are gone


def test_doubling_orders_all_suffixes():
    rng = random.Random(5)
    for _ in range(30):
        names = np.array([rng.randrange(3) for _ in range(rng.randint(1, 60))])
        expected = sorted(range(len(names)), key=lambda i: names[i:].tolist())
        assert suffix.doubled(names).tolist() == expected
