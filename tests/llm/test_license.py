"""License statements that stand close together."""

import time

from voxelloom.llm import license
from voxelloom.llm.setup import ready


def test_adjacent_copies_of_short_statements_are_all_found(spark):
    mit, apache = license.TEMPLATES["MIT statement"], license.TEMPLATES["Apache-2.0 statement"]
    texts = {
        "mit": (" ".join([mit] * 40), [(5 * i, 5 * i + 5) for i in range(40)]),
        "apache": ("\n".join([apache] * 7), [(8 * i, 8 * i + 8) for i in range(7)]),
        "apart": (f"{mit} and then {mit} again {mit}", [(0, 5), (7, 12), (13, 18)]),
    }
    docs = ready(spark).createDataFrame([(k, t) for k, (t, _) in texts.items()], "name string, text string")
    for row in license.scan(docs).collect():
        name = ("MIT" if row.name != "apache" else "Apache-2.0") + " statement"
        got = [(m.first, m.end) for m in row.licenses if m.license == name]
        assert got == texts[row.name][1] and all(m.coverage == 1.0 for m in row.licenses if m.license == name)


def test_very_many_copies_take_linear_time():
    index = license.Index(license.TEMPLATES, 3, 3)
    import numpy as np
    words = np.array(index.words[index.names.index("MIT statement")] * 3000, dtype=np.uint64)
    begin = time.time()
    assert len(license.find(words, index, 8, 0.8)) == 3000
    assert time.time() - begin < 60


def test_no_place_with_replaced_words_is_missed():
    """Random replacements up to the least coverage, against alignment over all diagonals."""
    import random

    import numpy as np

    index = license.Index(license.TEMPLATES, 3, 3)
    rng = random.Random(6)
    missed = tried = 0
    for t, words in enumerate(index.words):
        for _ in range(40):
            copy = list(words)
            for at in rng.sample(range(len(words)), rng.randint(0, len(words) // 5)):
                copy[at] = rng.getrandbits(63)
            text = [rng.getrandbits(63) for _ in range(rng.randint(0, 9))] + copy + [rng.getrandbits(63) for _ in range(5)]
            if license.align(words, text, -len(words), len(text))[0] >= 0.8 * len(words):
                tried += 1
                missed += not any(x[0] == t for x in license.find(np.array(text, dtype=np.uint64), index, 8, 0.8))
    assert tried > 300 and missed == 0
