"""Pseudonyms of the longest values that each format lets through."""

from __future__ import annotations

import re

import pytest

from tessera.llm import feistel


@pytest.mark.parametrize("labels", range(1, 9))
@pytest.mark.parametrize("size", [1, 2, 3, 31, 60, 62, 63])
def test_long_hosts_are_permuted_and_come_back(labels, size):
    p = feistel.Pseudonyms(b"k")
    host = ".".join(("abcdefghijklmnopqrstuvwxyz-0123456789" * 2)[:size].strip("-").ljust(size, "x") for _ in range(labels))
    text = f"mail {'u' * 64}@{host}.example now"
    done, kinds = p.encode(text)
    assert kinds == ["email"] or list(kinds) == ["email"]
    assert len(done) == len(text) and p.decode(done) == text
    if size > 3:
        assert done != text
    assert [len(x) for x in re.split("[.@]", done)] == [len(x) for x in re.split("[.@]", text)]


@pytest.mark.parametrize("bits", [1, 8, 319, 320, 327, 640, 641, 1000, 2600, 20_000])
def test_permutations_of_every_size_go_back(bits):
    p, size = feistel.Permutation(b"k"), (1 << bits) - 3 if bits > 2 else 3
    for x in {0, 1 % size, size // 2, size - 1}:
        y = p.forward(x, size, b"t")
        assert 0 <= y < size and p.backward(y, size, b"t") == x


@pytest.mark.parametrize("n", [16, 17, 95, 96, 97, 192, 193, 5000])
def test_long_secrets(n):
    p = feistel.Pseudonyms(b"k")
    text = f"token: {'aB3_' * (n // 4)}{'x' * (n % 4)} end"
    done, _ = p.encode(text)
    assert len(done) == len(text) and done != text and p.decode(done) == text


def test_a_table_with_a_long_host(spark):
    host = ".".join(["y" * 60] * 3)
    docs = spark.createDataFrame([(1, f"write to a@{host}.org"), (2, f"or to a@{host}.org, please"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in feistel.pseudonymise(docs).collect()}
    names = [re.search(r"\S+@[\w.]+[a-z]", got[i].text)[0] for i in (1, 2) if hasattr(got[i], "text")]
    assert len(got) == 3 and len(set(names)) <= 1
