"""Tessera: a PySpark-native engine for oriented 3-D points, the trees built
over them, and the blocks they are stored in."""
