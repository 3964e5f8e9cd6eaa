"""Windows are counted as packed codes, however many phrases are frequent."""

import inspect
from collections import Counter

import numpy as np

from plotgap.llm import phrases


def _counts(index, texts, k, parts, least):
    """Codes and counts of one level, and the blocks they went through."""
    mix, codes = phrases.Mix(index, parts), []
    for lang, words in texts:
        symbol = index.read(lang, words)
        state = index.states(symbol)
        at = np.nonzero((state[:-1] >= 0) & (state[1:] >= 0))[0]
        codes.append(state[at] * index.width + symbol[at + k - 1])
    dealt = mix.dealt(codes)
    got = [mix.counted([block], least) for block in dealt.column(1).to_pylist()]
    assert len(set(dealt.column(0).to_pylist())) == dealt.num_rows <= parts
    code, n = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in (0, 1))
    return code, n, sum(len(c) for c in codes)


def test_codes_and_blocks_count_every_safe_window():
    rng = np.random.default_rng(4)
    texts = [(lang, [b"%s%d" % (lang.encode(), w) if w < 60 else b"\n" for w in np.minimum(rng.geometric(0.05, 6000), 61).tolist()]) for lang in ("en", "de")]
    windows = {k: Counter((lang, " ".join(w.decode() for w in ws[i:i + k])) for lang, ws in texts for i in range(len(ws) - k + 1) if b"\n" not in ws[i:i + k]) for k in (1, 2, 3)}
    index = phrases.Index(sorted(p for p, n in windows[1].items() if n >= 8))
    for k in (2, 3):
        code, n, held = _counts(index, texts, k, 5, 8)
        langs, names = index.spelled(code)
        assert dict(zip(zip(langs, names), n.tolist())) == {p: m for p, m in windows[k].items() if m >= 8}
        assert held > 100 * 5  # windows go as a few blocks, not as rows
        index = phrases.Index(index.words, (*index.longer, np.sort(code)))


def test_half_a_gigabyte_of_texts_has_not_too_many_frequent_pairs():
    """303,270 pairs and 187,079 words were frequent there; beyond ``most`` windows are counted as rows of words."""
    assert inspect.signature(phrases.collocations).parameters["most"].default > 10 * 303_270
