from test_sitetree import pages

from inkveil.llm import sitetree as S


def test_copies_of_a_page_keep_their_text(spark):
    same = [(u, "<div class=story><p>The only page</p></div>") for u in [None, "/a", "b"] * 3]
    mostly = [("http://m.example/x", "<div class=box>Follow us</div><p>Copied</p>")] * 60
    mostly += [(f"http://m.example/{i}", f"<div class=box>Follow us</div><p>Unlike {i}</p>") for i in range(10)]
    got = {r["page_id"]: r["text"] for r in S.main_text(pages(spark, same + mostly)).collect()}
    assert [got[i] for i in range(9)] == ["The only page"] * 9
    assert [got[i] for i in range(9, 69)] == ["Copied"] * 60
    assert [got[i] for i in range(69, 79)] == [f"Unlike {i}" for i in range(10)]
