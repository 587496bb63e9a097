import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.operators import catalog, repair
from lectern.sources.epub import read_documents
from lectern.store import Store
from lectern.streaming import dropfolder
from tests.test_sources import book

HEAD = "中文名,日文名,英文名,年份,体裁,关键词,状态,格式,备注\n"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.init()
    return s


@pytest.fixture
def csv(tmp_path):
    f = tmp_path / "works.csv"
    f.write_text("\ufeff" + HEAD + '羊,,Sheep,1982,"[""novel""]",[],x,epub,\n , , , , , , , ,\n羊,,again,,,,,,\n', "utf-8")
    return f


def test_bootstrap(store, csv, tmp_path):
    assert catalog.bootstrap(store, str(csv)) == 1 and catalog.bootstrap(store, str(csv)) == 0
    with csv.open("a", encoding="utf-8") as f:
        f.write("井,ど,,（1999）,小说、essay,,,,n\n")
    assert catalog.bootstrap(store, str(csv)) == 1
    row = store.table("works").orderBy("id").collect()[1]
    assert (row.id, row.title_zh, row.year, row.genres, row.keywords, row.status) == (2, "井", "（1999）", ["小说", "essay"], [], None)
    assert catalog.bootstrap(store, str(tmp_path / "none.csv")) == 0


def add(store, files, csv, name="Field Notes.txt", text="one\ntwo words"):
    if not store.table("works").count():
        catalog.bootstrap(store, str(csv))
    src = files.parent / "in"
    src.mkdir(exist_ok=True)
    (src / name).write_text(text, "utf-8")
    return catalog.add_edition(store, str(files), str(src / name), 1, "en")


def test_add_and_delete(store, csv, tmp_path):
    files = tmp_path / "files"
    a, b = add(store, files, csv), add(store, files, csv)
    assert (a, b) == (1, 2) and store.table("segments").count() == 4
    assert store.table("editions").first().filename == "w1_en_Field_Notes.txt"
    assert catalog.delete_edition(store, str(files), 1, a)["file_status"] == "shared"
    got = catalog.delete_edition(store, str(files), 1, b)
    assert got["file_status"] == "deleted" and got["segment_count"] == 2 and not list(files.glob("*.txt"))
    assert store.table("segments").count() == 0 and store.table("segments", 3 + 1).count() in (2, 4)
    for work, edition, error in ((9, 1, schema.WorkMissing), (1, 9, schema.EditionMissing)):
        with pytest.raises(error):
            catalog.delete_edition(store, str(files), work, edition)


def test_an_edition_costs_its_own_files(store, csv, tmp_path):
    files = tmp_path / "files"
    a, b, c = (add(store, files, csv, f"f{i}.txt", f"text {i}\nmore") for i in range(3))
    folders = lambda: [g["folder"] for g in store.tables()["segments"]]
    before = folders()
    d = add(store, files, csv, "g.txt")
    assert folders()[:-1] == before
    catalog.delete_edition(store, str(files), 1, b)
    assert len(folders()) == len(before) and set(before) - set(folders()) == {before[-2]}
    assert store.merge() == store.version() and [g["editions"] for g in store.tables()["segments"]] == [None, [a, c, d]]
    repair.repair_edition(store, c, [(1, "New", "text 2"), (2, "New", "more")], apply=True)
    assert [g["editions"] for g in store.tables()["segments"]] == [None, [a, d], [c]]
    assert store.table("segments").count() == 6 and store.edition(c).where("chapter = 'New'").count() == 2
    assert store.table("segments").select("id").distinct().count() == 6


def test_a_pointer_is_there_whole_or_not_at_all(store, tmp_path):
    base = store.version()
    (tmp_path / "store" / "versions" / ".half").write_text("{")  # what a writer leaves that died before the rename
    assert store.version() == base and store.table("works").count() == 0
    again = Store(store.spark, store.path)
    assert store.commit({}, base) == base + 1
    with pytest.raises(schema.CorpusError):
        again.commit({}, base)
    with pytest.raises(schema.CorpusError):
        again._publish({}, base + 1)
    assert store.tables().keys() == {"works", "editions", "segments"}


def test_failures_leave_nothing(store, csv, tmp_path):
    files = tmp_path / "files"
    catalog.bootstrap(store, str(csv))
    bad = tmp_path / "bad.epub"
    bad.write_bytes(b"no zip")
    before = store.version()
    with pytest.raises(Exception):  # noqa: B017
        catalog.add_edition(store, str(files), str(bad), 1, "ja")
    assert store.version() == before and not list(files.glob("*.epub"))
    with pytest.raises(ValueError):
        catalog.add_edition(store, str(files), str(tmp_path / "x.doc"), 1, "ja")
    with pytest.raises(schema.ReadOnly):
        Store(store.spark, store.path, read_only=True).commit({}, before)
    with pytest.raises(schema.CorpusError):
        store.commit({}, before - 1)


def test_delete_goes_back_if_publishing_fails(store, csv, tmp_path, monkeypatch):
    files = tmp_path / "files"
    a = add(store, files, csv)
    monkeypatch.setattr(store, "commit", lambda *x: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        catalog.delete_edition(store, str(files), 1, a)
    assert len(list(files.glob("*.txt"))) == 1 and store.table("segments").count() == 2


@pytest.mark.parametrize("name", ["../escape.epub", "/tmp/escape.epub", "sub/book.epub", "sub\\book.epub", "C:\\escape.epub", ".", "..", ""])
def test_unsafe_names(tmp_path, name):
    with pytest.raises(schema.UnsafeFile):
        catalog.safe_file(str(tmp_path), name)


def test_stored_names():
    names = [("羊男.epub", "w1_zh_upload.epub"), ("Field Notes.PDF", "w1_zh_Field_Notes.pdf"), ("..\\..\\x.txt", "w1_zh_x.txt"), ("Café Ünï.epub", "w1_zh_Cafe_Uni.epub")]
    assert [catalog.stored_name(1, "zh", a) for a, _ in names] == [b for _, b in names]


def rows(*texts, chapters=None):
    return [{"id": 10 + i, "seq": i, "chapter": (chapters or {}).get(i, "old"), "content": t} for i, t in enumerate(texts, 1)]


DOCS = {"a.xhtml": "<head><title>Head A</title></head><h1>One</h1><p>text a</p>", "b.xhtml": "<head><title>Head B</title></head><h1>Two</h1>"}


def test_repair_plan():
    docs = read_documents(book(DOCS))
    parsed = [(1, "One", "One"), (2, "One", "text a"), (3, "Two", "Two")]
    good = repair.plan(rows("Head A", "One", "text a", "Head B", "Two"), parsed, docs)
    assert good.valid and len(good.legacy_titles) == 2 and len(good.changes) == 5 and good.mappings == {("old", "One"): 3, ("old", "Two"): 2} and good.matched_count == 3
    assert not repair.plan(rows("Head A", "One", "other", "Two"), parsed, docs).valid
    assert not repair.plan(rows("Extra", "One", "text a", "Two"), parsed, docs).valid
    assert len(repair.alignments(["t"] * 3, [(["t"], "t"), (["t"], "t")])) == 2
    flat = repair.plan(rows("One", "text a", "Two"), parsed)
    assert flat.valid and flat.matched_count == 3 and not repair.plan(rows("One"), parsed).valid
    assert not repair.plan([*rows("One"), {"id": 1, "seq": 3, "chapter": None, "content": "x"}], parsed).valid


def test_repair_apply(store, csv, tmp_path):
    edition = add(store, tmp_path / "files", csv)
    parsed = [(1, "New", "one"), (2, "New", "two words")]
    assert len(repair.repair_edition(store, edition, parsed).changes) == 2 and store.table("segments").where("chapter = 'New'").count() == 0
    repair.repair_edition(store, edition, parsed, apply=True)
    assert store.table("segments").where("chapter = 'New' and page is null").count() == 2
    assert repair.repair_edition(store, edition, parsed, apply=True).changes == []
    with pytest.raises(schema.RepairRefused):
        repair.repair_edition(store, edition, parsed[:1], apply=True)


def test_drop_folder(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo", "utf-8")
    q = dropfolder.watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("*")).first()[0] == 2
