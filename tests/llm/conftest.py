"""The session of the other tests serves here too."""
