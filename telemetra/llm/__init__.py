"""Training-data operators over ``documents``, ``pages`` and ``benchmark``; nothing else in
the library imports this subpackage."""
