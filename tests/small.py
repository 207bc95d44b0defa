"""Small inputs of our own."""

NOTES = {
    "tides.md": "# Reading tide tables\n\nHarbour pilots compare the printed tide with the gauge. Spring tides follow the new moon and the full moon.\n",
    "hives.md": "# Hive inspection\n\nSmoke calms the colony before frames are lifted. Mark the queen and count sealed brood.\n",
    "glaze.md": "# Mixing a celadon glaze\n\nFeldspar, silica and whiting are sieved twice. Celadon turns green in a reducing kiln.\n",
}
#: Shares a word with one note.
MAIL = {"one.txt": "Open studio on Sunday?\nWe unload the kiln and the celadon bowls at noon.\n"}


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    return str(root)


def ranked(spark, scores, sources=None, qid="q"):
    rows = [(qid, i + 1, i, float(s), (sources or [{}] * len(scores))[i]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "qid string, rank int, doc_id long, score double, sources map<string,double>")
