import re

import pytest

from tessera.functions.globs import glob_regex, literal_prefix, specificity

CASES = [
    ("src/**", "src/a/b.go", True), ("src/**", "src", True), ("src/**", "srcx/a", False), ("**/x.go", "x.go", True), ("**/x.go", "a/b/x.go", True), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/b/c", False),
    ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("*.{go,py}", "m.py", True), ("*.{go,py}", "m.rs", False), ("f[0-3].go", "f2.go", True), ("f[!0-3].go", "f2.go", False), ("f?.go", "f/.go", False), ("a.b", "axb", False), ("a+(b)", "a+(b)", True),
]


@pytest.mark.parametrize("glob,path,hit", CASES)
def test_glob(glob, path, hit):
    assert bool(re.search(glob_regex(glob), path)) is hit


def test_prefix_and_errors():
    assert literal_prefix("src/a/**") == "src/a/" and specificity("é/*") == 3
    for bad in ("a[b", "a{b"):
        with pytest.raises(ValueError):
            glob_regex(bad)
