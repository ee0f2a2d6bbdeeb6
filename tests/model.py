"""Plain-Python models of the search, to compare with."""

from collections import deque


def distances(out, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in out.get(v, ()):
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


def all_paths(out, start, finish):
    back: dict = {}
    for v, ws in out.items():
        for w in ws:
            back.setdefault(w, []).append(v)
    near, far = distances(out, start), distances(back, finish)
    if finish not in near:
        return []
    paths, todo = [], [[start]]
    while todo:
        path = todo.pop()
        if path[-1] == finish:
            paths.append(path)
            continue
        for w in out.get(path[-1], ()):
            if w in far and near[path[-1]] + 1 + far[w] == near[finish]:
                todo.append([*path, w])
    return sorted(paths)
