"""Components for the test of extensions."""


class Vowels:
    """A model of one token for each vowel."""

    def __init__(self, config):
        self.vocab = {v: k for k, v in enumerate(config["vowels"])}

    def tokens(self, word):
        return [(self.vocab[c], c, k, k + 1) for k, c in enumerate(word) if c in self.vocab]


def swap(config):
    return lambda t: t.mapped(str.swapcase)


def joined(config):
    return lambda tokens: ["-".join(tokens)]
