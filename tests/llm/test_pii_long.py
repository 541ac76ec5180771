import random

import pytest

from lodestar.llm import pii


@pytest.mark.parametrize("n", [129, 700, 5000])
def test_long_secrets_are_found_whole(n):
    token = "".join(random.Random(n).choices(pii.MIXED, k=n - 1)) + "7"
    (_, chosen), = pii._found([f"key = '{token}' end"], pii.judge())
    assert chosen == [("secret", 7, 7 + n)]
