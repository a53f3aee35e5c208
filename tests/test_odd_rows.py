"""Queries over rows that the driver's small tables lack, against the SQL that states their results."""

import duckdb
import pytest

from lexmill import plans
from tests.test_queries import table


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over the rows of one table gives what its SQL gives."""

    def run(name, source, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{source}.parquet")
        con = duckdb.connect()
        con.execute(f"create view {source} as select * from read_parquet('{tmp_path}/{source}.parquet/*.parquet')")
        got, want = plans.QUERIES[name](spark, str(tmp_path)), con.execute(plans.SQL[name])
        columns = [d[0] for d in want.description]
        found = table(got.collect(), got.columns)
        assert len(found) > 0
        assert found == table(want.fetchall(), columns)

    return run


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_informative_filter_of_blank_texts(same):
    texts = [None, "", "   ", "\n \t\n", "src1", "one two three four five six seven eight", "\nsrc1\n\none two three four five six seven eight"]
    same("informative_filter", "documents", [(i, t, lang, "src1", len(t or "")) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("de", "en"))], DOCUMENTS)


def test_html_extract_of_cut_off_references(same):
    body = "<html><head><title>{0}</title></head><body><script>if (a && b) x = '&amp'</script><!-- &amp <script> --><nav><a href=\"/a?b=1\">x</a></nav><h1>{0}</h1><p>{0} &lt;b&gt; &quot;q&quot;</p></body></html>"
    heads = ["tied &amp;&amp;&amp", "tied &amp;&am", "tied &a", "tied &", "&copy;&copy", "&lt;&lt", "a &amp;lt; b &ampc; && d", "plain"]
    same("html_extract", "pages", [(i, f"https://example.org/{i}", body.format(h)) for i, h in enumerate(heads)], "page_id long, url string, html string")


def test_references_without_semicolon_are_a_choice():
    from lexmill.operators.html import HtmlParams, fields_of

    page = "<body><h1>a &amp b</h1><style>x && y</style><p>c &copy</p></body>"
    assert fields_of(page, "", HtmlParams())[:2] == ("a & b", "a & b\nc ©")
    assert fields_of(page, "", HtmlParams(bare_references=False))[:2] == ("a &amp b", "a &amp b\nc &copy")


def test_term_chunks_of_single_letters(same):
    texts = ["token a bc f f a af c a d f The eroneaha thea ering lythly", "Est une ment anpavi token cfd f f d c c ecfd fd c ouletion", "a b c " * 200, "a", "", "long words only " * 300]
    same("term_chunks", "documents", [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
