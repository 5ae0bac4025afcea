import pytest

from pagequarry.operators import campaigns
from pagequarry.sources import readers

BODY = [f'u{i}@x.org,"name {i}{chr(10) if i % 7 == 0 else " "}and ""more"", {i}",{"" if i % 5 else "s"}' for i in range(400)]
TEXTS = {
    "header": "Email,name,seg\n" + "\n".join(BODY),
    "plain": "\n".join(BODY) + "\n\n  \n",
    "tabs": "name\tyour mail\r\n" + "\r\n".join(f"n{i}\tm{i % 50}@y.org" for i in range(300)),
    "semicolons": "\n".join(f"n, {i};v{i}@z.org;" for i in range(300)),
    "loose": "a@b.org\nc@d.org e@f.org\n" + "\n".join(f"l{i}@loose.org" for i in range(200)),
    "open quote": 'e-mail,x\np@q.org,"never closed\nr@s.org,2\n',
    "one": "only@one.org",
    "no address": "first\tsecond\nx\ty\n",
    "wide": "h@i.org\nj@k.org,1,2,3\n",
}


def whole(spark):
    return readers.split_lists(spark.createDataFrame(list(TEXTS.items()), "list_id string, text string"))


def flat(parsed):
    recipients, invalid, stats = parsed
    return (
        sorted((r.list_id, r.row, r.email, tuple((f.k, f.v) for f in r.fields)) for r in recipients.collect()),
        sorted((r.list_id, r.row, r.value) for r in invalid.collect()),
        sorted(tuple(r) for r in stats.collect()),
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("lists")
    for name, text in TEXTS.items():
        (top / f"list_id={name}").mkdir()
        (top / f"list_id={name}" / "part.txt").write_bytes(text.encode())
    return str(top)


@pytest.mark.parametrize("block", ["128m", "700b"])
def test_records_of_split_files_are_those_of_whole_texts(spark, folder, block):
    """Blocks far smaller than a file cut records with quoted line ends; results stay those of the text as a whole."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = readers.read_list_records(spark, folder)
        got = flat(campaigns.parse_records(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = flat(campaigns.parse_recipients(whole(spark)))
    assert got == want
    assert len([r for r in got[0] if r[0] == "header"]) == 400


def test_empty_folder_of_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("")
    assert readers.read_list_records(spark, str(tmp_path)).count() == 0
