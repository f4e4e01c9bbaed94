"""Versions of one family of licences are told apart."""

import pytest

from lexspark.llm import licenses


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("Ths wrk is licnsed undr the GNU General Public License, version 3", "GPL-3.0"),
        ("GNU General Public License, version 3", "GPL-3.0"),
        ("GNU General Public Licence, version 3.", "GPL-3.0"),
        ("GNU General Public Licence, version 2", "GPL-2.0"),
        ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ],
)
def test_version_is_told(text, want):
    scanner = licenses.Scanner()
    assert [scanner.notices[i][0] for i, *_ in scanner.scan(f"xx yy. {text} zz")] == [want]


@pytest.mark.parametrize("text", ["GNU General Public License, version 1", "GNU General Public License, version 23", "GNU General Public License, version "])
def test_other_versions_are_no_match(text):
    assert licenses.Scanner().scan(text) == []
