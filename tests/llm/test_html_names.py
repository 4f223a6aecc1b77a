"""Columns of a page's own that bear the names of results or helpers."""

from tapeworks.llm.html_text import extract_main_text

PAGE = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>One two three four five six.</p></article></body></html>"


def test_clashing_names(spark):
    rows = [(1, f"https://a.org/{i}", PAGE, "keep", "p", i, "old", "t", i, [i]) for i in range(3)] + [(None, None, None, None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, __host string, __path string, __page int, TEXT string, __text string, n_chars int, `a.b` array<int>")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "__host", "__path", "__page", "__text", "a.b", "text", "n_chars"]
    out = {r["url"]: r for r in got.collect()}
    assert len(out) == 4 and out[None]["text"] == "" and out[None]["n_chars"] == 0
    for i in range(3):
        r = out[f"https://a.org/{i}"]
        assert r["text"] == "Title One two three four five six." and r["n_chars"] == len(r["text"])
        assert (r["__host"], r["__path"], r["__page"], r["__text"], r["a.b"]) == ("keep", "p", i, "t", [i])
    assert extract_main_text(pages.select("url", "html")).columns == ["url", "text", "n_chars"]
