"""Very long and deeply nested pages."""

import time

from fleetlens.llm import html_extract


def test_a_page_of_open_tags_takes_linear_time():
    words = "text of the article goes here " * 30
    for page in ("<div>" * 200_000 + words, "<span>" * 80_000 + f"<div>{words}</div></x>" + "</y>" * 100_000, "<div><p>a few words of text" * 30_000):
        began = time.perf_counter()
        text = html_extract.extract(page)
        assert text and time.perf_counter() - began < 20  # a second or two; minutes if each tag looked through all open ones


def test_the_smallest_common_element_is_kept():
    inner = "<p>one two three four</p><p>five six seven eight</p>"
    assert html_extract.extract(f"<body><div><div>{inner}</div></div><div>x</div></body>") == "one two three four\nfive six seven eight"
    assert html_extract.extract(f"<body><article><div>{inner}</div><p>end</p></article><p>out</p></body>").endswith("end")
