"""What follows the size of the input: groups of keys, token files; where tables in between go."""

import pytest

import duckdb
from wrenchwork.llm import frames, oracle, token_counts
from wrenchwork.llm.quality_rules import quality_rules
from wrenchwork.session import INITIAL_PARTITIONS


@pytest.fixture
def settings(spark):
    kept = spark.conf.get(INITIAL_PARTITIONS, None)
    yield
    spark.conf.unset(INITIAL_PARTITIONS) if kept is None else spark.conf.set(INITIAL_PARTITIONS, kept)


def test_groups_follow_the_bytes(spark, settings, monkeypatch):
    spark.conf.unset(INITIAL_PARTITIONS)
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frames.shards(spark) == 2 * fewest
    counts = []
    for each in (1 << 18, 1 << 16, 1 << 14):
        monkeypatch.setattr(frames, "BYTES_PER_PARTITION", each)
        counts.append(frames.shards(frames.sized(spark, "/root/testdata/sf0.01")))
    assert counts[1] > 3 * counts[0] and counts[2] > 3 * counts[1]


def test_no_local_folder_on_a_cluster():
    class Cluster:
        """A session like the given one, on another master."""

        class conf:
            get = staticmethod(lambda name, default=None: "spark://host:7077" if name == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.shared_folder(Cluster)


def test_a_long_text_has_a_token_file_of_its_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "FILE_TOKENS", 50)
    texts = ["a b c", "", None, "word " * 500, "d", "e " * 30, "f " * 30, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    encoder = token_counts._encoder(open(token_counts.Vocabulary().path, "rb").read(), token_counts.PATTERN)
    assert [rows[i].n_tokens for i in range(len(texts))] == [len(encoder.encode_ordinary(t or "")) for t in texts]
    per_file = {}
    for r in rows.values():
        per_file.setdefault(r.file, []).append(r.n_tokens + 1)
    assert len(per_file) > 3
    assert all(sum(sizes) <= 51 or len(sizes) == 1 for sizes in per_file.values())


def test_sentence_marks_of_other_scripts_in_the_sql(spark):
    line = " ".join(f"word{i}" for i in range(40))
    marks = [".", "", "।", "۔", "؟", "።", "？", "\U00011047", "†"]
    texts = [f"{line}{m}\n{line} end{i}." for i, m in enumerate(marks)]
    texts += [f"{line}.\n{line} x.\n{p}" for p in ("Alle Rechte vorbehalten", "Mentions légales", "Aviso legal y más")]
    rows = list(enumerate(texts))
    judged = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: (r.kept, r.lost_words) for r in judged.select("doc_id", "quality.kept", "quality.lost_words").collect()}
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar)")
    connection.executemany("insert into documents values (?, ?)", rows)
    result = connection.execute(f"select doc_id, kept, lost_words from ({oracle.SQL['op1_quality_rules']})").fetchall()
    assert got == {doc: (kept, lost) for doc, kept, lost in result}
    assert [i for i in got if got[i][1]] == [1, 8, 9, 10, 11]
