"""What a task remembers between the blocks of text that it works on. It ends with the task, so idle workers hold nothing."""

from __future__ import annotations


class Memory(dict):
    """A dictionary that, when it has grown past a limit, keeps what has been asked for again since the last time."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.again = most, set()

    def missing(self, keys: set) -> set:
        """Those of the keys that it lacks. Called before a block's entries are added."""
        new = keys - self.keys()
        self.again |= keys - new
        if len(self) > self.most:
            kept = {k: self[k] for k in self.again}
            self.clear()
            # Should nearly all be asked for again, it starts anew.
            self.update(kept if len(kept) < self.most else {k: kept[k] for k in keys - new})
            self.again = set()
        return new
