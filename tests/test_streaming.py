"""Running statistics of a folder: what stops goes on where it was, and no file counts twice."""

import shutil

from strandframe.operators import stats
from strandframe.sources.fastq import read_fastq
from strandframe.streaming import counts


def test_stream_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()

    def arrive(name, *lengths):
        (folder / name).write_text("".join(f"@{name}{i}\n{'ACGTN' * n}\n+\n{'I5#?!' * n}\n" for i, n in enumerate(lengths)))

    def run():
        counts.stream_stats(spark, str(folder), str(out), str(checkpoint), once=True).awaitTermination(100)
        return counts.totals(spark, str(out)).first().asDict()

    def whole():
        r = stats.read_stats(read_fastq(spark, str(folder))).first().asDict()
        return {c: r[c] for c in got}

    arrive("a.fq", 3, 1)
    arrive("b.fq", 7)
    got = run()
    assert got == whole() and got["reads"] == 3 and (got["min_length"], got["max_length"]) == (5, 35)
    arrive("c.fq", 0, 2, 9)
    got = run()
    assert got == whole() and got["reads"] == 6 and (got["min_length"], got["max_length"]) == (0, 45)
    # A batch that was counted but not noted as done is counted again in its place.
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    (checkpoint / "commits" / str(last)).unlink()
    (checkpoint / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert run() == whole()
    shutil.rmtree(folder)
