"""Plain versions of operators, for small inputs."""

import re
from collections import defaultdict

LAST = 2**63 - 1


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def groups(ids, linked):
    """The smallest id that each id reaches, over given pairs."""
    found = {i: i for i in ids}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        found[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def removed_lines(docs):
    """From ``{doc_id: text}`` the numbers of the lines that go, by looking at all pairs that share a shingle."""
    places = defaultdict(list)
    for doc_id in sorted(docs, key=lambda i: LAST if i is None else i):
        for at, line in enumerate((docs[doc_id] or "").split("\n") if docs[doc_id] is not None else []):
            if normal(line):
                places[normal(line)].append((doc_id, at))
    lines = list(places)
    sets = [shingles(line) for line in lines]
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for shingle in own:
            holders[shingle].append(k)
    linked = []
    for k, own in enumerate(sets):
        common = defaultdict(int)
        for shingle in own:
            for other in holders[shingle]:
                if other < k:
                    common[other] += 1
        linked += [(k, other) for other, n in common.items() if n >= 0.8 * (len(own) + len(sets[other]) - n)]
    members = defaultdict(list)
    for k, group in groups(range(len(lines)), linked).items():
        members[group] += places[lines[k]]
    gone = defaultdict(list)
    for own in members.values():
        for doc_id, at in sorted(own, key=lambda place: (LAST if place[0] is None else place[0], place[1]))[1:]:
            gone[doc_id].append(at)
    return {doc_id: sorted(at) for doc_id, at in gone.items()}


def without(text, gone):
    return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in set(gone))
