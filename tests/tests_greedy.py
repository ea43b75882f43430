"""The greedy pass over names in order, one after the other."""

from ledgerloom.functions.similarity import token_set


def greedily(rows, least, proposal):
    """(cluster, score, role) by id, one name after the other."""
    heads, out = [], {}
    for i, norm in sorted(rows):
        score, head = 0.0, None
        for h, text in heads:
            if (s := float(int(token_set(norm, text)))) > score:
                score, head = s, h
        if head is not None and score >= proposal:
            out[i] = (head, score, "member" if score >= least else "proposal")
        else:
            heads.append((i, norm))
            out[i] = (i, 100.0, "member")
    return out
