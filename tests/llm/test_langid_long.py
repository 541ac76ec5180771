import base64

import numpy as np
import pytest

from lodestar.llm import langid


def test_long_pieces_are_read_and_summed(tmp_path):
    words = ["a", "b", "ab", "b" * 9, "ab" * 9]
    (tmp_path / "v").write_text("".join(f"{base64.b64encode(w.encode()).decode()} {i}\n" for i, w in enumerate(words)))
    pieces = langid.read_pieces(tmp_path / "v")
    assert pieces == sorted(words)
    p = {w: (i + 1) / 100 for i, w in enumerate(pieces)}
    table = np.array([[*p.values(), 1e-6, 0.0]]).T
    ways = [1.0]
    word = "ab" * 10
    for i in range(1, len(word) + 1):
        ways.append(sum(ways[k] * p.get(word[k:i], 0.0) for k in range(i)))
    assert langid.log_scores(langid.Pieces(pieces), table, [word])[0, 0] == pytest.approx(np.log(ways[-1]))
    (tmp_path / "w").write_text(base64.b64encode(b"a" * (langid.LONGEST + 1)).decode() + " 0\n")
    with pytest.raises(ValueError, match="a piece has over"):
        langid.read_pieces(tmp_path / "w")
