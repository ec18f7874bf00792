"""Trees as nested dictionaries, and what the engine computes, by plain recursion."""

import base64
import hashlib


def digest(data: bytes) -> str:
    return base64.b64encode(hashlib.sha256(data).hexdigest().encode())[:20].decode()


class Tree:
    """Names to strings (files), dictionaries (directories) or None (errors)."""

    def __init__(self, children: dict):
        self.children = children

    def entries(self):
        def walk(path, node):
            if node is None:
                yield path, "E", None, 0, 0
            elif isinstance(node, str):
                yield path, "F", digest(node.encode()), len(node) % 7, len(node)
            else:
                yield path, "D", None, 0, 4096
                for n, c in node.items():
                    yield from walk(f"{path}/{n}", c)

        yield from walk("root", self.children)

    def nodes(self):
        out = []

        def walk(path, node):
            if node is None:
                made = ("E", "ERROR", 0, 0, 1)
            elif isinstance(node, str):
                made = ("F", digest(node.encode()), len(node) % 7, len(node), 1)
            else:
                inner = [walk(f"{path}/{n}", c) for n, c in node.items()]
                made = ("D", digest("".join(h + "\n" for h in sorted(x[1] for x in inner)).encode()), max([0, *(x[2] for x in inner)]), 4096 + sum(x[3] for x in inner), 1 + sum(x[4] for x in inner))
            out.append((path, *made))
            return made

        walk("root", self.children)
        return out

    def changed(self, rng):
        def walk(node):
            if not isinstance(node, dict):
                return node if rng.random() < 0.8 else rng.choice(["new", "other", {"k": "v"}])
            out = {n: walk(c) for n, c in node.items() if rng.random() > 0.15}
            if rng.random() < 0.3:
                out["added"] = rng.choice(["a", {"b": "c"}])
            names = [n for n, c in out.items() if isinstance(c, dict)]
            if len(names) > 1 and rng.random() < 0.5:
                out[names[0]], out[names[1]] = out[names[1]], out[names[0]]
            return out

        return Tree(walk(self.children))

    def diff(self, new):
        def info(tree):
            return {p: (t, h) for p, t, h, *_ in tree.nodes()}

        old_info, new_info = info(self), info(new)

        def walk(path, a, b):
            if old_info[path] == new_info[path] and isinstance(a, dict) and isinstance(b, dict):
                return
            if not (isinstance(a, dict) and isinstance(b, dict)):
                if old_info[path][0] != new_info[path][0]:
                    yield "rm", path
                    yield "add", path
                elif old_info[path][1] != new_info[path][1]:
                    yield "edit", path
                return
            for n in a.keys() - b.keys():
                yield "rm", f"{path}/{n}"
            for n in b.keys() - a.keys():
                yield "add", f"{path}/{n}"
            for n in a.keys() & b.keys():
                yield from walk(f"{path}/{n}", a[n], b[n])

        return [(op, p.removeprefix("root").lstrip("/")) for op, p in walk("root", self.children, new.children)]


def random_tree(rng, errors=True):
    def make(depth):
        out = {}
        for i in range(rng.randint(0 if depth else 3, 4)):
            kind = rng.random()
            if depth < 4 and kind < 0.5:
                out[f"d{i}"] = make(depth + 1)
            elif errors and kind > 0.95:
                out[f"e{i}"] = None
            else:
                out[f"f{i}"] = rng.choice(["a", "b", "c", "dd", ""])
        return out

    return Tree(make(0))
