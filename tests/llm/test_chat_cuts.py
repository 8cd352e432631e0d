"""Parts whose turn numbers repeat come in cuts of bounded size that make up the whole rendering."""

from corpusloom.llm import chat_format


def test_repeated_and_null_turns(spark):
    rows = [(None, k % 7, ("ann", "bob", "system")[k % 3], f"text {k % 50}") for k in range(400)] + [(1, None, "ann", "same")] * 300 + [(1, 3, "bob", "end"), (2, 0, "ann", "one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {}
    for r in sorted(chat_format.render(df, 16).collect(), key=lambda r: r.part_start):
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {(None, "ann"): 25, (None, "bob"): 25, (1, "ann"): 20, (1, "bob"): 20, (2, "ann"): 1}
    for (conv, who), parts in got.items():
        assert max(r.n_turns for r in parts) <= 16
        whole = "".join(r.text for r in parts)
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        head = lambda role: "assistant" if role == who else "system" if role == "system" else f"user name={role}"
        assert whole == "".join(f"<|im_start|>{head(r[2])}\n{r[3]}<|im_end|>\n" for r in mine)
        at = 0
        for r in parts:
            spans = [tuple(map(int, s.split(":"))) for s in r.masks.split(",") if s]
            assert r.part_start == at and r.n_masked == sum(b - a for a, b in spans) and all(r.text[:a].endswith("assistant\n") and r.text[a:b].endswith("<|im_end|>") for a, b in spans)
            at += len(r.text)
        assert sum(len(r.masks.split(",")) for r in parts if r.masks) == sum(r[2] == who for r in mine)
