from lectern import cli
from tests.test_sources import book
from tests.test_store import DOCS, HEAD


def test_commands(spark, tmp_path):
    said: list[str] = []

    def run(*args):
        said.clear()
        return cli.main(["--store", str(tmp_path / "s"), "--files", str(tmp_path / "f"), *map(str, args)], spark, said.append)

    (tmp_path / "w.csv").write_text(HEAD + "羊,,Sheep,1982,,,,,\n", "utf-8")
    (tmp_path / "b.epub").write_bytes(book(DOCS | {"c.xhtml": "<h1>Chapter 1</h1><p>the sheep man</p>"}))
    assert run("init") == 0 and run("import", tmp_path / "w.csv") == 0 and said == ["1 works added"]
    assert run("add", tmp_path / "b.epub", "--work", 1, "--lang", "en") == 0 and said == ["edition 1"]
    assert run("list") == 0 and said == ["1\t1982\t羊\t1/1"]
    assert run("search", "sheep") == 0 and said == ["羊 [英] Chapter 1: the [sheep] man", "1 hits"]
    assert run("read", 1) == 0 and said[0].startswith("羊 / Chapter 1")
    assert run("repair-chapters", 1) == 0 and said[-1].startswith("nothing written")
    assert run("read", 9) == 1 and run("add", tmp_path / "b.doc", "--work", 1, "--lang", "en") == 1
    assert run("delete", 1, 1) == 0 and "file_status: deleted" in said
