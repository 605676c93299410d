"""Streams of point events over the engine's geometry; an addition to what the batch operators answer."""
