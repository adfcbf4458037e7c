"""The mutation log as a stream."""
