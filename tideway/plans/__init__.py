"""Whole jobs put together from operators; each is one lazy plan unless it says otherwise."""
