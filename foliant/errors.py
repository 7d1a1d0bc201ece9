"""Exception hierarchy with stable machine codes and a recoverable flag."""

from __future__ import annotations


class FoliantError(Exception):
    code = "ERROR"
    recoverable = False

    def as_dict(self) -> dict:
        return {"code": self.code, "message": str(self), "recoverable": self.recoverable}


# The machine codes callers match on.


class DesktopDirNotFound(FoliantError):
    code = "DESKTOP_DIR_NOT_FOUND"


class DataLocalDirNotFound(FoliantError):
    code = "DATA_LOCAL_DIR_NOT_FOUND"


class InvalidPath(FoliantError):
    code = "INVALID_PATH"


class WatcherAlreadyRunning(FoliantError):
    code = "WATCHER_ALREADY_RUNNING"
    recoverable = True


class WatcherNotRunning(FoliantError):
    code = "WATCHER_NOT_RUNNING"
    recoverable = True


class IoFailure(FoliantError):
    code = "IO_ERROR"


class NotifyFailure(FoliantError):
    code = "NOTIFY_ERROR"


class FileNameMissing(FoliantError):
    code = "FILE_NAME_MISSING"


class StreamClosed(FoliantError):
    code = "STREAM_CLOSED"
    recoverable = True


class InitializationFailed(FoliantError):
    code = "INITIALIZATION_FAILED"


class StorageFailure(FoliantError):
    code = "SQLITE_ERROR"


class IndexNotInitialized(FoliantError):
    code = "INDEX_NOT_INITIALIZED"


class ModelLoadFailed(FoliantError):
    code = "MODEL_LOAD_FAILED"


class ModelDownloadFailed(FoliantError):
    code = "MODEL_DOWNLOAD_FAILED"


class ModelNotInitialized(FoliantError):
    code = "MODEL_NOT_INITIALIZED"


class EmbeddingComputeFailed(FoliantError):
    code = "EMBEDDING_COMPUTE_FAILED"


class LlmLoadFailed(FoliantError):
    code = "LLM_LOAD_FAILED"


class LlmNotLoaded(FoliantError):
    code = "LLM_NOT_LOADED"


class LlmGenerationFailed(FoliantError):
    code = "LLM_GENERATION_FAILED"


class ConcurrentUpdate(FoliantError):
    code = "CONCURRENT_UPDATE"
    recoverable = True
