"""History at block borders."""

import pytest

from quivra.llm import chat


@pytest.mark.parametrize("block", [2, 3, 5, 100])
def test_history_crosses_blocks(spark, block):
    turns = [(0, 0, "system", "be kind")] + [(c, t, "user" if t % 2 else "assistant", f"turn {t} " * 3) for c in (0, None) for t in range(1, 14) if t != 6]
    history, budget = 24, 60
    found = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget, history, block).collect()
    for conv in (0, None):
        lines = {t: f"<s>{r}\n{x}</s>" for c, t, r, x in turns if c == conv}
        size = lambda t: -(-len(lines[t]) // 4)
        rows, seen = sorted((w for w in found if w["conv_id"] == conv), key=lambda w: (w["block"], w["window"])), []
        for w in rows:
            parts = [p + "</s>" for p in w["formatted"].split("</s>")[:-1]]
            context, own = parts[: w["n_context"]], parts[w["n_context"] :]
            want, room = [], history
            for t in reversed([t for t in seen if t]):
                room -= size(t)
                if room < 0:
                    break
                want.insert(0, lines[t])
            assert context == ([lines[0]] if conv == 0 and seen else []) + want
            seen += [t for x in own for t, line in lines.items() if line == x]
            assert w["n_tokens"] <= budget
        assert seen == sorted(lines)
