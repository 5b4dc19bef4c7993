"""The rule over all annotators of a bucket at once gives what a loop over each annotator's votes gives."""

import numpy as np

from tidemark.streaming.stopping import NONE, RULE, StoppingRule


def test_packed_rules_equal_a_loop_over_batches():
    rng = np.random.default_rng(8)
    rule, state, want_state = StoppingRule(4), np.zeros((len(RULE), 0), dtype=np.int64), {}
    for batch in range(6):
        votes = np.stack([rng.choice([NONE, 3, 7, 11, 500], 40), rng.integers(0, 99, 40) + 100 * batch,
                          rng.integers(0, 10**6, 40), (rng.random(40) < 0.25).astype(np.int64)])
        votes = votes[:, np.lexsort((votes[2], votes[1], votes[0]))]
        state, out = rule._run(state, votes)
        want = []
        for a, us, _, vote in votes.T.tolist():
            pos, last, stop, dropped, _ = want_state.get(a, (0, -1, -1, 0, 0))
            kept = None
            if stop >= 0:
                dropped += 1
            else:
                kept = vote
                last = pos if vote == 1 else last
                stop = pos if pos - last >= 4 else -1
            want.append((None if a == NONE else a, pos, vote, kept, stop >= 0, dropped))
            want_state[a] = (pos + 1, last, stop, dropped, us)
        got = [tuple(None if v is not v or str(v) == "<NA>" else v for v in r) for r in out.itertuples(index=False)]
        assert got == want
        rows = {r[0]: tuple(r[1:]) for r in state.T.tolist()}
        assert rows.keys() == want_state.keys()
        assert all(rows[a][0] == w[0] and rows[a][2:] == w[2:] for a, w in want_state.items())
    assert any(w[2] >= 0 for w in want_state.values()) and any(w[3] for w in want_state.values())
