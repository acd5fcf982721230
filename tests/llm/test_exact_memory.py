"""What the tries of op11 hold is what they say they hold."""

import hashlib
import os
import tracemalloc

from tablelens.llm import exact_dedup as E


def test_a_trie_knows_its_memory():
    keys = [os.urandom(8).hex().encode() * 3 for _ in range(5_000)]
    tracemalloc.start()
    try:
        trie = E.Trie()
        for i, key in enumerate(keys):
            number = (1 << 36) + i
            trie.insert(key).owner = E._Owner(number, (number + 7, number), 1, len(key), hash(key), hashlib.sha256(key).hexdigest())
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert 0.95 * held <= trie.bytes <= 1.3 * held
