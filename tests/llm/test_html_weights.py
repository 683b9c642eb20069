"""Main text by learned weights: the scan, names, forms and labels that are hidden."""

import random
import time

import pytest

from fleetlens.llm import html_extract as H

WORDS = " ".join(f"word{i}" for i in range(60))


def learned(pages):
    total = H.Counter()
    for page in pages:
        total.update(H.page_counts(page))
    votes = {}
    for (kind, value, inside), n in total.items():
        if kind == "name":
            i, o = votes.get(value, (0, 0))
            votes[value] = (i + n, o) if inside else (i, o + n)
    return H.Scores(votes=votes)


def test_scan_equals_all_runs():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(0, 12)
        scores, ends = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(n)], [rng.random() < 0.7 for _ in range(n)]
        runs = [sum(scores[i : j + 1]) for i in range(n) for j in range(i, n) if ends[j]]
        got = H.best_region(scores, ends)
        if got is None:
            assert max(runs, default=0.0) <= 0
        else:
            assert ends[got[1]] and sum(scores[got[0] : got[1] + 1]) == max(runs)


@pytest.mark.parametrize("name", ["discussion", "popular", "trending", "feedback", "legal"])
def test_labelled_pages_outweigh_the_list(name):
    page = f"<body><div class='{name}'><p>{WORDS}</p></div></body>"
    shown = f"<body><nav>a</nav><article><div class='{name}'><p>{WORDS}</p></div></article></body>"
    advert = f"<body><article><p>{WORDS}</p><div class='{name}'>buy this now</div></article></body>"
    assert H.extract(page) == "" == H.extract(page, learned([advert] * 50))  # a short box inside is no vote for its name
    assert H.extract(page, learned([shown] * 50)) == WORDS


def test_names_that_only_labelled_pages_know():
    labelled = f"<body><article><p>{WORDS}</p></article><div class='zzrail'>some words beside it</div></body>"
    page = f"<body><div class=story><p>{WORDS}</p><div class='zzrail right'>some words beside it</div><p>end</p></div></body>"
    assert "beside" in H.extract(page) and H.extract(page, learned([labelled] * 30)) == WORDS + "\nend"


def test_unknown_names_do_not_hide_boilerplate():
    assert H.extract(f"<body><div><p>{WORDS}</p><div class='clearfix sidebar'>beside</div><p>end of it</p></div></body>") == WORDS + "\nend of it"


def test_forms():
    inner = f"<nav>menu</nav><div><h1>Title</h1><p>{WORDS}</p><form><input><p>Subscribe now</p></form></div><footer>f</footer>"
    assert H.extract(f"<body><form id=aspnet>{inner}</form></body>") == H.extract(f"<body>{inner}</body>") == f"Title\n{WORDS}"
    assert H.extract("<body><form><label>Name</label><input></form></body>") == ""


def test_hidden_labels_and_spark(spark, data):
    """Scores are learned from half of the pages; of the others the article's tags are hidden, and their text has to be
    that of the article."""
    rows = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect() if r.html]
    scores = H.learned_scores(spark.createDataFrame([(h,) for h in rows[::2]], "html string"))
    assert scores.votes["ad"][1] == len(rows[::2]) and scores.links[3] < scores.links[0]
    hidden = [h.replace("<article>", "<div class=c1>").replace("</article>", "</div>") for h in rows[1::2]]
    same = sum(H.extract(h, scores) == H.extract(o, scores) != "" for h, o in zip(hidden, rows[1::2], strict=True))
    assert same >= 0.98 * len(hidden)


def test_no_labels_and_no_pages(spark):
    assert H.learned_scores(spark.createDataFrame([("<p>x</p>",), (None,), ("",)], "html string")) == H.Scores()
    assert H.learned_scores(spark.createDataFrame([], "html string")) == H.Scores()
    assert not H.page_counts("<article>a</article><article>b</article>")


def test_a_megabyte_of_tags():
    began = time.perf_counter()
    assert H.extract("<div>" * 200_000 + WORDS)
    assert time.perf_counter() - began < 10  # about a second
