"""What the driver's Python holds on to after its own work: it counts beside everything that runs later."""

import re

from asofmill.llm import queries
from asofmill.llm.bpe import Codec
from asofmill.session import give_back


def held() -> int:
    """KB of this process, without mapped files."""
    with open("/proc/self/smaps_rollup") as file:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", file.read())))


def test_automaton_is_indexed_where_it_reads():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        codec = Codec(file.read())
    assert not codec.automaton.inner and not codec.automaton.final
    assert codec.decode(codec.encode("hello")).replace("</w>", "") and codec.automaton.inner


def test_freed_memory_goes_back():
    give_back()
    before = held()
    parts = [bytes(3000) for _ in range(30_000)]
    kept = parts[::1000]
    del parts  # what is left lies between the gaps, so the C library keeps them
    assert held() - before > 50_000
    give_back()
    assert held() - before < 20_000 and len(kept) == 30
